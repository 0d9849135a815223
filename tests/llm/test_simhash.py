import itertools

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from cases import EDGES
from textlake.llm import simhash
from textlake.llm.components import connected_components


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, budget):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= budget:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [t or "" for _, t in EDGES] + ["a b c", "a b c d", "A b\x0bC d e f", "É é"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("near", [0.0, 0.5, 0.98])
def test_trie_join_links_what_brute_force_links(near):
    rng = np.random.default_rng(int(near * 100))
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    keys = []
    for _ in range(600):
        k = int(rng.integers(0, 1 << 63, dtype=np.uint64))
        if rng.random() < near:
            k = int(base[rng.integers(4)])
            for b in rng.integers(0, 60, rng.integers(0, 7)):
                k ^= 1 << int(b)
        keys.append(k)
    keys = sorted(set(keys))
    key = np.array(keys, dtype=np.uint64)
    got = simhash.trie_links(np.zeros(len(key), dtype=int), key, 0, 4, most=500)
    assert got.tolist() == plain_components(keys, 4)


@pytest.mark.parametrize("tile", [200_000, 20])
def test_components_over_blocks_and_tiles(spark, tile):
    rng = np.random.default_rng(5)
    fps = {0, 2**64 - 1}
    for _ in range(40):
        k = int(rng.integers(0, 1 << 62)) << 2
        fps.add(k)
        for _ in range(6):
            k ^= sum(1 << int(b) for b in set(rng.integers(0, 64, 4)))
            fps.add(k)
    hot = 0xABCDEF0123456789
    fps |= {hot ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(30)}
    fps = sorted(fps)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long, rep long"), 4, tile)
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == plain_components(fps, 4)


def test_documents(docs):
    rows = [r for r in EDGES if r[0] is not None]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_groups(docs(*rows)).collect()}
    fps = [plain_fingerprint(t or "") for _, t in rows]
    groups = plain_components(fps, 4)
    least = {g: min(rows[i][0] for i in range(len(rows)) if groups[i] == g) for g in groups}
    assert got == {(rows[i][0], f"{fps[i]:016x}"): least[groups[i]] for i in range(len(rows))}
    assert simhash.simhash_groups(docs()).count() == 0


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 1000), (1000, 950), (5, 5)], "a long, b long").repartition(3)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000: 900, 950: 900}
    assert connected_components(edges.where("a < 0")).count() == 0


def test_query_on_the_table(spark, sf):
    from textlake.llm.queries import op1_simhash

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", rows[g].doc_id) for r, f, g in zip(rows, fps, plain_components(fps, 4))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, sf).collect()} == want


def test_rows_without_and_with_repeated_ids(spark, docs, monkeypatch):
    """Links go by fingerprint: also over a row without an id, and not between texts that only share an id."""
    made = {"a": 0, "b": 0b1111, "c": 0b11111111, "d": 0xF0F0F0F0 << 16, "e": 0x123456789ABCDEF}
    monkeypatch.setattr(simhash, "fingerprints", lambda df, *a: df.selectExpr("doc_id", "cast(text as long) as fp"))
    rows = lambda *x: docs(*[(i, str(made[k])) for i, k in x])
    out = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.simhash_groups(df).collect())
    assert out(rows((1, "a"), (None, "b"), (3, "c"))) == [(-1, 1), (1, 1), (3, 1)]
    assert out(rows((3, "a"), (5, "b"), (5, "e"), (9, "e"))) == [(3, 3), (5, 3), (5, 5), (9, 5)]
    assert out(rows((None, "d"))) == [(-1, None)]
