"""Encoding by the tokenizers library, with memos of white-space chunks and words.

Both vocabularies split a text at white space before they merge anything, so a chunk's ids do not depend on what stands
around it; nor do those of the words (pre-tokens) in it. A word is encoded by the library's model when a worker first
meets it; memos are bounded and keep what was used lately.

Latin texts are cut into words at once. Others are cut into chunks first:

* `dropped`: white space never yields an id (word_bpe_49k). Chunks are the words between white space.
* `attached`: one space belongs to what follows it (byte_bpe_50k). Texts are cut into chunks before single spaces; those
  where a space has white space beside it (the cut then depends on its surroundings) go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from sys import getsizeof

import numpy as np

from textlake.llm.common import CACHES

# What Python's str.split() takes for white space and the tokenizer does not.
_CONTROL = re.compile("[\x1c-\x1f]")
# Letters below U+0250 whose lower case is a letter beyond it.
_FAR = "".join(c for c in map(chr, range(0x250)) if any(x > "\u024f" and x.isalpha() for x in c.lower()))
#: What the patterns below cannot cut; a vocabulary of the first kind puts texts in lower case before they are cut.
_NOT_LATIN = {"dropped": re.compile(f"[^\0-\u024f]|[{_FAR}]"), "attached": re.compile("[^\0-\u024f]")}
_UNCLEAR = re.compile(r" \s|\s ")
#: Bytes of a generation of the memos, by what is kept; a worker holds at most two generations of each.
MB = 1 << 20
CHUNKS, WORDS = 24 * MB, 36 * MB
#: The same for words of Latin texts; a lower-cased vocabulary has room for the rare ones too.
LATIN_WORDS = {"dropped": 64 * MB, "attached": 48 * MB}
#: Longer keys are made anew each time: they hardly come again.
LONG = 200
#: What an entry takes beside key and value.
ENTRY = 100

# Letters, numbers and white space below U+0250, where all Unicode versions agree and composed forms stay as they are.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_ENDS = "'s|'t|'re|'ve|'m|'ll|'d"
_PATTERNS = {
    "dropped": re.compile(f"[{_L}]+|[{_N}]|{_ENDS}|[^{_S}{_L}{_N}]+"),
    "attached": re.compile(f"{_ENDS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"),
}

LOADED: dict[tuple[str, str], "Encoder"] = {}
CACHES.append(LOADED)


class Memo(dict):
    """Values made on first use. Of two generations of `room` bytes the older one goes when the newer is full."""

    def __init__(self, make, room: int):
        super().__init__()
        self.make, self.room, self.size, self.old = make, room, 0, {}

    def __missing__(self, key):
        if len(key) > LONG:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.size >= self.room:
            self.old, self.size = dict(self), 0
            self.clear()
        self.size += ENTRY + getsizeof(key) + getsizeof(value)
        self[key] = value
        return value


def byte_letters() -> dict[int, str]:
    """For each byte the printable letter that byte-level vocabularies write for it."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(shifted)}


_LETTERS = byte_letters()


def load_tokenizer(path: str):
    """A tokenizer without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def words(tok, space: str, text: str) -> list[str]:
    """The text's pre-tokens in byte letters. Latin text is cut here, all other by the tokenizer's own parts."""
    if not _NOT_LATIN[space].search(text):
        if space == "dropped":
            text = text.lower()
        found = _PATTERNS[space].findall(text)
        if text.isascii() and " " not in text and text.isprintable():
            return found
        return [w.encode().decode("latin-1").translate(_LETTERS) for w in found]
    if tok.normalizer:
        text = tok.normalizer.normalize_str(text)
    return [w for w, _ in tok.pre_tokenizer.pre_tokenize_str(text)]


def chunks(space: str, text: str) -> list[str] | None:
    """The text's chunks, or None if it must be encoded whole."""
    flat = text.replace("\n", " ")
    plain = flat.isprintable()  # no white space but spaces and line feeds
    if not plain and _CONTROL.search(text):
        return None
    if space == "dropped":
        return text.split()
    if (not plain or "  " in flat) and _UNCLEAR.search(text):
        return None
    first, *rest = text.split(" ")
    # "" after a cut is a space at the end of the text
    return ([first] if first else []) + [" " + x for x in rest]


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers, in bytes."""

    def __init__(self, path: str, space: str):
        self.tok, self.space = load_tokenizer(path), space
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words = Memo(self.word, WORDS)
        self.chunks = Memo(self.chunk, CHUNKS)
        self.latin_words = Memo(self.latin_word, LATIN_WORDS[space])
        self.model = self.tok.model

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        if self.special and self.special.search(chunk):
            return self.whole(chunk)
        return b"".join(map(self.words.__getitem__, words(self.tok, self.space, chunk)))

    def latin_word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()) or " " in word:
            word = word.encode().decode("latin-1").translate(_LETTERS)
        return self.word(word)

    def latin(self, text: str) -> bool:
        """Whether the whole text can be cut here: Latin letters, no control characters, no special tokens."""
        if _NOT_LATIN[self.space].search(text) or self.special and self.special.search(text):
            return False
        return text.replace("\n", " ").isprintable() or not _CONTROL.search(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        get, latin, cut, out = self.chunks.__getitem__, self.latin_words.__getitem__, _PATTERNS[self.space].findall, []
        lowered = self.space == "dropped"
        for t in texts:
            if self.latin(t):
                out.append(b"".join(map(latin, cut(t.lower() if lowered else t))))
                continue
            c = chunks(self.space, t)
            out.append(self.whole(t) if c is None else b"".join(map(get, c)))
        return out


def encoder(path: str, space: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if (path, space) not in LOADED:
        LOADED[path, space] = Encoder(path, space)
    return LOADED[path, space]
