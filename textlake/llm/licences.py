"""Licence scans by a generalised suffix automaton of the words of licence templates.

A text is streamed through the automaton word by word. At each word its state tells the matching statistics: the longest
piece of any template that ends here, and where in the templates it stands. Names of licences (phrases) are templates too;
they stand wherever the state, or one above it by suffix links, is theirs, so every place is found.

Pieces of `shortest` words or more that the next word does not continue are chained by template: along a chain places grow
in the text and in the template, with at most `gap` words left out on either side between two pieces, and words that two
pieces share count once. A chain that covers `cover` of the template's words or more is a span. Spans that overlap compete:
the one that covers more words stays (a notice for non-commercial use holds all words of the one without). A label is reported
for every span and every phrase. The score is the largest coverage of any template, reported or not; a phrase covers itself.

Words are runs of ASCII letters and digits and of all that is not ASCII, with A-Z in lower case. Texts are read as bytes, in
blocks, so bytes that are no UTF-8 are parts of words, and what a task holds of a text is its bytes and the pieces found.

Defined cases: a null text counts as empty; no words, or none known, give no labels and a score of 0; texts of any length are
scanned whole; repeated rows and ids are scanned each for itself; equal chains go to the earlier place, then the earlier
template; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import text_slices
from textlake.llm.licence_texts import PHRASES, TEMPLATES
from textlake.llm.suffix_automaton import SuffixAutomaton
from textlake.session import ship_package

SHORTEST, GAP, COVER = 4, 12, 0.75
#: Bytes of a text that are cut into words at once.
BLOCK = 1 << 20
#: For each byte, the lower-case letter, digit or byte beyond ASCII, or a space for what stands between words.
_FLAT = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def words_of(text: bytes) -> Iterator[bytes]:
    """The words of a text, block by block."""
    flat, at = text.translate(_FLAT), 0
    while at < len(flat):
        end = flat.find(b" ", at + BLOCK)
        end = len(flat) if end < 0 else end
        yield from flat[at:end].split()
        at = end


class Templates:
    """The automaton of a set of phrases and templates, and what a scan with it finds."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], shortest: int = SHORTEST, gap: int = GAP, cover: float = COVER):
        self.shortest, self.gap, self.cover = shortest, gap, cover
        self.phrases = list(phrases)
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        cut = [list(words_of(t.encode())) for t in [*phrases, *(t for _, t in templates)]]
        self.vocabulary: dict[bytes, int] = {}
        strings = [tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws) for ws in cut]
        self.sizes = list(map(len, strings))
        self.bits = len(self.vocabulary).bit_length()
        self.sam = sam = SuffixAutomaton(strings, list(range(len(strings))), self.bits)
        # By state, the phrases that end there: (words, phrase).
        self.ends = {s: own for s, found in enumerate(sam.matches) if (own := [(n, p) for n, p in found if p < len(phrases)])}
        # By state, where its strings end: (template, words of it so far). Only for states long enough to be asked.
        places: list[list[tuple[int, int]]] = [[] for _ in sam.length]
        for t, string in enumerate(strings):
            state = 0
            for k, c in enumerate(string, 1):
                state = sam.step[state << self.bits | c]
                places[state].append((t, k))
        for s in sorted(range(1, len(sam.length)), key=sam.length.__getitem__, reverse=True):
            if sam.length[sam.link[s]] >= shortest:
                places[sam.link[s]] += places[s]
        self.places = places

    def stream(self, words: Iterator[bytes]) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int]]]:
        """How many words there are, the phrases' places (start, phrase), and the pieces (end, words, state)."""
        known, step, bits, ends, shortest = self.vocabulary.get, self.sam.step.get, self.bits, self.ends, self.shortest
        link, length = self.sam.link, self.sam.length
        found, pieces = [], []
        i = state = size = 0
        for c in map(known, words):
            if c is None:
                if size >= shortest:
                    pieces.append((i, size, state))
                state = size = 0
            else:
                to = step(state << bits | c)
                if to is None:
                    if size >= shortest:
                        pieces.append((i, size, state))
                    while to is None:  # the root goes on with every known word
                        state = link[state]
                        size = length[state]
                        to = step(state << bits | c)
                state, size = to, size + 1
                if state in ends:
                    found += [(i + 1 - n, p) for n, p in ends[state] if n <= size]
            i += 1
        if size >= shortest:
            pieces.append((i, size, state))
        return i, found, pieces

    def chains(self, template: int, items: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """Disjoint best chains of a template's pieces, (start, end, covered). items: (start, end, start in the template)."""
        items.sort()
        total, back, live = [], [], []
        for k, (a, b, x) in enumerate(items):
            best, before = b - a, -1
            live = [j for j in live if items[j][1] >= a - self.gap]
            for j in live:
                c, d, y = items[j]
                z = y + d - c  # its end in the template
                if c < a and y < x <= z + self.gap:
                    now = total[j] + b - a - max(0, d - a, z - x)
                    if now > best and now > total[j]:
                        best, before = now, j
            total.append(best)
            back.append(before)
            live.append(k)
        used = set()
        for k in sorted(range(len(items)), key=lambda k: (-total[k], k)):
            path, j = [], k
            while j >= 0 and j not in used:
                path.append(j)
                j = back[j]
            if j < 0:
                used.update(path)
                yield items[path[-1]][0], items[k][1], total[k]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, str, int, float]], float]:
        """Words, places of phrases, spans (start, end, label, words covered, coverage) by start, and the score."""
        n, found, pieces = self.stream(words_of(text))
        by_template = defaultdict(list)
        for end, size, state in pieces:
            for t, k in self.places[state]:
                if t >= len(self.phrases):
                    by_template[t].append((end - size, end, k - size))
        spans, score = [], 1.0 if found else 0.0
        for t, items in by_template.items():
            for a, b, covered in self.chains(t, items):
                share = covered / self.sizes[t]
                score = max(score, share)
                if share >= self.cover:
                    spans.append((-covered, a, b, t, share))
        kept: list[tuple[int, int, str, int, float]] = []  # by start; they do not overlap
        for less, a, b, t, share in sorted(spans):
            k = bisect_left(kept, (a,))
            if (not k or kept[k - 1][1] <= a) and (k == len(kept) or b <= kept[k][0]):
                kept.insert(k, (a, b, self.labels[t], -less, share))
        return n, found, kept, score


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("covered", pa.int64()), ("coverage", pa.float64())])
_PLACE = pa.struct([("start", pa.int64()), ("phrase", pa.string()), ("label", pa.string())])
SCHEMA = """doc_id long, n_words long, places array<struct<start: long, phrase: string, label: string>>,
    spans array<struct<start: long, end: long, label: string, covered: long, coverage: double>>, score double"""


def scan_licences(df: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places of phrases, spans of templates (both in words from 0, end exclusive) and score, for every row."""
    ship_package(df.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(phrases, templates)
        for part, texts in text_slices(parts):
            n, found, spans, score = zip(*map(known.scan, texts))
            places = [[{"start": a, "phrase": known.phrases[p], "label": known.labels[p]} for a, p in ps] for ps in found]
            spans = [[dict(zip(("start", "end", "label", "covered", "coverage"), s)) for s in ss] for ss in spans]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(n, pa.int64()), pa.array(places, pa.list_(_PLACE)), pa.array(spans, pa.list_(_SPAN)), pa.array(score, pa.float64())],
                names=["doc_id", "n_words", "places", "spans", "score"],
            )

    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, SCHEMA)


def licence_digest(found: DataFrame) -> DataFrame:
    """What scan_licences() finds, a plain row per document: counts, first and last place, labels."""
    listed = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    base: Column = F.col("places.label")
    starts = F.col("places.start")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, F.col("spans.label"))).alias("labels"),
        "score",
    )
