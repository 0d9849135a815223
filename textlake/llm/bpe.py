"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that can come last in its encoding. A suffix automaton of the
vocabulary, fed symbol by symbol, names the tokens that are suffixes of the prefix; token t fits at the end if the last
token of what stands before it and t are compatible, that is, if the merges applied to the two put together would leave
them apart. Following the back-pointers from the whole word emits its ids. No merge is ever carried out.

A word is a sequence of symbols: a byte, or a byte that ends the word (where the vocabulary marks word ends). The text
is normalised and cut into words as the tokenizer file says (see tokens.words); the strings of special tokens
are cut out first, as the library does.

Defined cases: a null text counts as empty and has no ids; texts and words may be of any length; an empty table gives an
empty result; repeated rows and ids are encoded each for itself.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textlake.llm.common import CACHES, documents, text_slices
from textlake.llm.suffix_automaton import SuffixAutomaton
from textlake.llm.tokens import CHUNKS, WORDS, Memo, byte_letters, chunks, load_tokenizer, words
from textlake.session import ship_package

#: Pairs of tokens whose compatibility is remembered, about 100 bytes each.
PAIRS = 300_000
_LOADED: dict[str, "Bpe"] = {}
CACHES.append(_LOADED)


#: Machines here and everywhere Spark runs store integers little end first, as the ids are given.
assert sys.byteorder == "little" and array("I").itemsize == 4


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], {c: b for b, c in byte_letters().items()}
        self.end = model.get("end_of_word_suffix") or ""
        self.tok = load_tokenizer(path)
        vocab: dict[str, int] = model["vocab"]
        self.text_of = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of |= {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = letters
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[int, int] = {}
        birth, left, right = {}, {}, {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault(x << 20 | y, r)
            if z not in birth:
                birth[z], left[z], right[z] = r, x, y
        self.birth, self.left, self.right = birth, left, right
        strings, names = [], []
        for t, i in vocab.items():
            ends = bool(self.end) and t.endswith(self.end)
            symbols = [letters[c] for c in (t[: -len(self.end)] if ends else t)]
            if ends:
                symbols[-1] |= 256
            strings.append(tuple(symbols))
            names.append(i)
        self.automaton = SuffixAutomaton(strings, names)
        self.pairs: dict[int, bool] = {}
        self.space = "dropped" if self.end else "attached"
        self.words, self.chunks = Memo(self.word, WORDS), Memo(self.chunk, CHUNKS)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b apart where b follows a.

        The piece of a at the border goes through the right spine of a's merge tree, that of b through the left spine;
        each piece lives from its own merge's rank until that of the piece above it. A merge over the border takes
        place if its rank falls into the lives of both its pieces; equal ranks go from left to right.
        """
        right, left, birth, rank = self.right, self.left, self.birth, self.rank
        xs, ys = [(a, 1 << 60)], [(b, 1 << 60)]
        while (x := xs[-1][0]) in birth:
            xs.append((right[x], birth[x]))
        while (y := ys[-1][0]) in birth:
            ys.append((left[y], birth[y]))
        for x, x_dies in xs:
            x_born = birth.get(x, -1)
            for y, y_dies in ys:
                if y_dies <= x_born:
                    continue
                y_born = birth.get(y, -1)
                if y_born >= x_dies:
                    continue
                r = rank.get(x << 20 | y)
                if r is not None and x_born < r < x_dies and y_born < r <= y_dies:
                    return False
        return True

    def word_ids(self, symbols: list[int]) -> list[int]:
        """The ids of a word: last[i] is the one token that comes last in the encoding of the first i symbols."""
        sam, pairs = self.automaton, self.pairs
        step, length, link, matches = sam.step.get, sam.length, sam.link, sam.matches
        n = len(symbols)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        state = size = i = 0
        for c in symbols:
            i += 1
            while (t := step(state << 9 | c)) is None and state:
                state = link[state]
                size = length[state]
            if t is None:
                raise ValueError(f"the vocabulary lacks the symbol {c}")
            state, size = t, size + 1
            for k, token in matches[state]:
                if k > size:
                    continue
                if j := i - k:
                    key = last[j] << 20 | token
                    if (fits := pairs.get(key)) is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fits = pairs[key] = self.compatible(last[j], token)
                    if not fits:
                        continue
                last[i], back[i] = token, j
                break
            else:
                raise ValueError("no token fits; the vocabulary's merges are not well-formed")
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def word(self, word: str) -> bytes:
        """The ids of a word in byte letters."""
        symbols = [self.letters[c] for c in word]
        if self.end:
            symbols[-1] |= 256
        return array("I", self.word_ids(symbols)).tobytes()

    def plain(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        return b"".join(map(self.words.__getitem__, words(self.tok, self.space, text)))

    def chunk(self, chunk: str) -> bytes:
        if not self.cut:
            return self.plain(chunk)
        parts = self.cut.split(chunk)
        return b"".join([array("I", [self.special[x]]).tobytes() if k % 2 else self.plain(x) for k, x in enumerate(parts) if x])

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers, in bytes."""
        found = chunks(self.space, text)
        return self.chunk(text) if found is None else b"".join(map(self.chunks.__getitem__, found))

    def decode(self, ids: list[int]) -> str:
        """As the library decodes where the file names no decoder: the tokens' texts, joined by spaces."""
        return " ".join(map(self.text_of.__getitem__, ids))


def bpe(path: str) -> Bpe:
    """One per worker process and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_documents(df: DataFrame, vocab: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and if asked for ids and decoded, for every whole text."""
    ship_package(df.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocab)
        for part, texts in text_slices(parts, own=_LOADED):
            found = [coder.encode(t) for t in texts]
            decoded = [coder.decode(array("I", x)) for x in found]
            out = {
                "doc_id": part["doc_id"],
                "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()),
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in found],
                "decoded_sha256": [hashlib.sha256(y.encode()).hexdigest() for y in decoded],
            }
            if with_ids:
                out["ids"] = pa.array([np.frombuffer(x, "<u4").astype("i4") for x in found], pa.list_(pa.int32()))
                out["decoded"] = decoded
            yield pa.RecordBatch.from_pydict(out)

    return documents(df, id_col, text_col).mapInArrow(run, schema)
