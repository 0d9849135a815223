"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton names the pieces that end at each character; dynamic programming keeps, per position, the best
score and the number of pieces on the best path, and no path. Ties are settled as in the tokenizers library's unigram
model: of equal scores at a position the piece that starts first wins; a character without a piece of its own may be
unknown, at the lowest score less 10; a run of unknown characters is one token, or with byte fallback one per byte.

The text is cut before spaces, each written as the word mark, and a mark is put before the first word; so a word's count
does not depend on its surroundings and is kept in a bounded memo.

Defined cases: a null or empty text has no tokens; texts and words of any length are counted whole; repeated rows are
counted each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from textlake.llm.common import CACHES, documents, text_slices
from textlake.llm.tokens import Memo
from textlake.session import ship_package

MARK = "▁"
#: Bytes of a generation of the memo.
WORDS = 48 << 20
_LOADED: dict[tuple[str, bool], "Counter"] = {}
CACHES.append(_LOADED)


def sentencepiece_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) of every entry of a sentencepiece file, in its order, and the unknown piece's id."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - 10.0
        pieces = {p for p, _ in vocabulary}
        self.longest = max(map(len, pieces))
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.words = Memo(lambda w: self.viterbi(MARK + w), WORDS)

    def viterbi(self, word: str) -> int:
        """The number of pieces on the best path."""
        # Rings as long as the longest piece: what lies further back is not asked for again.
        ring = self.longest + 1
        score, pieces, unknown = [0.0] * ring, [0] * ring, [False] * ring
        floor, in_bytes, found = self.unknown, self.bytes, self.automaton.iter(word)
        end, match = next(found, (-1, None))
        for i in range(1, len(word) + 1):
            best, start, single = None, 0, False
            matches = []
            while end == i - 1:
                matches.append(match)
                end, match = next(found, (-1, None))
            if len(matches) > 1:
                matches.sort(reverse=True)
            for length, s in matches:
                s += score[(i - length) % ring]
                if best is None or s > best:
                    best, start = s, i - length
                single = single or length == 1
            is_unknown = False
            if not single:
                s = floor + score[(i - 1) % ring]
                if best is None or s > best:
                    best, start, is_unknown = s, i - 1, True
            at, start = i % ring, start % ring
            score[at], unknown[at] = best, is_unknown
            if not is_unknown:
                pieces[at] = pieces[start] + 1
            elif in_bytes:
                pieces[at] = pieces[start] + len(word[i - 1].encode("utf-8", "surrogatepass"))
            else:
                pieces[at] = pieces[start] + (not unknown[start])
        return pieces[len(word) % ring]

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(" ", MARK).split(MARK)
        if not words[0]:
            words = words[1:]
        return sum(map(self.words.__getitem__, words))


def counter(path: str, byte_fallback: bool = True) -> Counter:
    """One per worker process and vocabulary."""
    if (path, byte_fallback) not in _LOADED:
        _LOADED[path, byte_fallback] = Counter(sentencepiece_vocabulary(path)[0], byte_fallback)
    return _LOADED[path, byte_fallback]


def count_tokens(df: DataFrame, vocab: str, byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens for every row."""
    ship_package(df.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocab, byte_fallback)
        for part, texts in text_slices(parts, own=_LOADED):
            counts = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")
