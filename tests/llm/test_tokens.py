import hashlib
import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from cases import EDGES
from textlake.llm import bpe, packing, token_counts, token_files, tokens
from textlake.llm.queries import vocabulary

ALPHABET = "abcdefghie ntsrlAEIOU'stvemld 0123 .,!?\n\t\x1c\x85\x0b éèüßñ日本Σς²½́😀<|endoftext|>İKﬁ"
rnd = random.Random(3)
LATIN = "abc  dSE'stvem \n\t\x0b\x85\xa0éß²½İœ.,!?-_ 019"
TEXTS = ["".join(rnd.choice(LATIN) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + [t or "" for _, t in EDGES] + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000, "===" * 50, " lead", "trail ", "a\n\nb", "a \n b", "don't DON'T ' s"]


def library(name):
    return tokens.load_tokenizer(vocabulary(name))


@pytest.mark.parametrize("name,space", [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "attached")])
def test_encoder_is_the_library(name, space):
    tok, enc = library(name), tokens.Encoder(vocabulary(name), space)
    enc.words.room = enc.chunks.room = enc.latin_words.room = 100_000  # generations turn over
    for t, got in zip(TEXTS, enc.encode(TEXTS)):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


# Letters, marks, digits, signs and white space of many scripts: every character below U+0250, and some of each further plane.
PLANES = [chr(c) for c in range(1, 0x250)] + [chr(rnd.choice(range(a, b))) for a, b in ((0x250, 0x600), (0x600, 0x900), (0x900, 0x1200), (0x1E00, 0x2100), (0x2100, 0x3000), (0x3040, 0xA000), (0xAC00, 0xD7A0), (0xF900, 0xFFF0), (0x10000, 0x10400), (0x1D400, 0x1D800), (0x1F300, 0x1FA00), (0x20000, 0x2A000), (0xE0000, 0xE0080)) for _ in range(60)]
LETTERS = [form for c in map(chr, range(1, 0x250)) for form in (c, f"{c}an wasa", f"wa{c}", f"a{c}a n{c} ", f"{c}{c}1{c}", f"A{c.upper()}'s")]


@pytest.mark.parametrize("name,space", [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "attached")])
def test_ids_of_all_planes_are_those_of_the_library(name, space):
    """Every letter below U+0250 in several places of a word, and random texts over all planes, in both encoders."""
    tok, enc, coder = library(name), tokens.Encoder(vocabulary(name), space), bpe.Bpe(vocabulary(name))
    far = random.Random(11)
    texts = LETTERS + ["".join(far.choice(PLANES if far.random() < 0.5 else "abc DEé  \n") for _ in range(far.randint(1, 14))) for _ in range(50_000)]
    want = [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]
    for t, ids, got in zip(texts, want, enc.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == ids, repr(t)
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == ids, repr(t)


def test_chunks_do_not_depend_on_the_rest():
    tok = library("byte_bpe_50k.json")
    for a, b in product(["a", "é'", "\n", "1\n", "<|endoftext|>", "'", " x", "\t"], [" b", " 's", " é", " 1", " <|endoftext|>", " ."]):
        whole = tok.encode("x" + a + b, add_special_tokens=False).ids
        parts = tokens.chunks("attached", "x" + a + b)
        if parts:
            assert whole == [i for p in parts for i in tok.encode(p, add_special_tokens=False).ids], (a, b)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_prefix_programming_gives_the_ids_of_the_library(name):
    coder, tok = bpe.Bpe(vocabulary(name)), library(name)
    for t in TEXTS:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == ids, repr(t)
        if name.startswith("word"):
            assert coder.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_compatible_pairs():
    coder, tok = bpe.Bpe(vocabulary("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    names = {i: t for t, i in tok.get_vocab().items()}
    for _ in range(5000):
        a, b = rnd.randrange(20_000), rnd.randrange(20_000)
        assert coder.compatible(a, b) == ([t.id for t in tok.model.tokenize(names[a] + names[b])] == [a, b])


def test_bpe_query(spark, docs):
    tok = library("word_bpe_49k.json")
    rows = {r.doc_id: r for r in bpe.encode_documents(docs(*EDGES[:12]), vocabulary("word_bpe_49k.json")).collect()}
    for i, t in EDGES[:12]:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        r = rows[i]
        assert r.n_tokens == len(ids) and r.ids == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_documents(docs(), vocabulary("word_bpe_49k.json")).count() == 0


def test_fill_is_the_best_subset():
    for _ in range(300):
        counts = {rnd.randint(1, 40): rnd.randint(1, 3) for _ in range(rnd.randint(1, 5))}
        room = rnd.randint(0, 70)
        sums = {sum(n * k for n, k in zip(counts, ks)) for ks in product(*[range(c + 1) for c in counts.values()])}
        chosen = packing.fill(room, sorted(counts), counts)
        used = defaultdict(int)
        for n, k in chosen:
            used[n] += k
        assert all(used[n] <= counts[n] for n in used)
        assert sum(n * k for n, k in chosen) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("flush", [100_000, 3])
def test_packing(docs, flush):
    tok = library("word_bpe_49k.json")
    rows = EDGES[:12] + [(100 + i, "the cat " * rnd.randint(0, 2500)) for i in range(60)]
    out = packing.pack_documents(docs(*rows), vocabulary("word_bpe_49k.json"), flush=flush).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i in ids:
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == len(ids[i])
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    if flush > 3:
        total = sum(map(len, ids.values()))
        assert len(sequences) <= total / 2048 + 4  # a short one for each of three partitions
    assert packing.pack_documents(docs(), vocabulary("word_bpe_49k.json")).count() == 0


def test_token_files(spark, docs, tmp_path):
    tok = library("byte_bpe_50k.json")
    rows = [r for r in EDGES if r[1] != "repeated id"]
    folder = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs(*rows), folder, vocabulary("byte_bpe_50k.json"), 0, n_ids=50_257)
    got = token_files.read_token_files(spark, folder, with_ids=True).collect()
    at = 0
    by_id = {r.doc_id: r for r in got}
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        r = by_id[i]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(rows) and sum(p.stat().st_size for p in (tmp_path / "tokens").glob("*.ids")) == 2 * at
    wide = token_files.token_file_rows(docs((1, "abc")), f"file://{tmp_path}/wide", vocabulary("byte_bpe_50k.json"), 0, n_ids=1 << 17)
    assert wide.first().n_tokens == 2 and sum(p.stat().st_size for p in (tmp_path / "wide").glob("*.ids")) == 8
    assert token_files.token_file_rows(docs(), f"file://{tmp_path}/none", vocabulary("byte_bpe_50k.json"), 0).count() == 0


def unigram(vocabulary_, unknown, byte_fallback):
    tok = Tokenizer(models.Unigram(vocabulary_, unknown, byte_fallback))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return tok


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_counts_are_those_of_the_unigram_model(byte_fallback):
    entries, unknown = token_counts.sentencepiece_vocabulary(vocabulary("piece_bpe_32k.model"))
    tok, counter = unigram(entries, unknown, byte_fallback), token_counts.Counter(entries, byte_fallback)
    for t in TEXTS:
        if len(t) < 10_000:
            assert counter.count(t) == len(tok.encode(t).ids), repr(t)


def test_ties():
    for pieces in (["▁", "a", "b", "ab", "aba", "ba", "▁a"], ["▁", "a", "aa", "aaa"]):
        entries = [("<unk>", 0.0)] + [(p, -1.0 * (1 + k % 2)) for k, p in enumerate(pieces)]
        tok, counter = unigram(entries, 0, False), token_counts.Counter(entries, False)
        for n in range(1, 7):
            for t in product("ab z", repeat=n):
                assert counter.count("".join(t)) == len(tok.encode("".join(t)).ids), t


def test_counts_of_a_long_word_take_little_memory():
    import tracemalloc

    counter = token_counts.Counter(token_counts.sentencepiece_vocabulary(vocabulary("piece_bpe_32k.model"))[0])
    word = "abcdefghij" * 3_000
    counter.count(word[:1000])
    tracemalloc.start()
    counter.count(word)
    assert tracemalloc.get_traced_memory()[1] < 10 * len(word)  # the automaton has a copy of the word
    tracemalloc.stop()


def test_token_files_are_read_in_pieces(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "MOST_TOKENS", 64)
    test_token_files(spark, docs, tmp_path)


def test_count_query(docs):
    entries, unknown = token_counts.sentencepiece_vocabulary(vocabulary("piece_bpe_32k.model"))
    tok = unigram(entries, unknown, True)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(*EDGES[:12]), vocabulary("piece_bpe_32k.model")).collect()}
    assert got == {i: len(tok.encode(t or "").ids) for i, t in EDGES[:12]}
