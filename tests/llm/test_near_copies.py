import itertools
import random

import corpus_pipeline as cp
import numpy as np

from cases import EDGES
from textlake import session
from textlake.llm import near_copies, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or set(filter(None, [tuple(words)]))


def groups(texts):
    """Brute force: the first row of each row's component."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def texts():
    """Unrelated texts, of each some copies with 1 to 6 % of words replaced, and a common passage in many."""
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    passage = [f"p{i}" for i in range(30)]
    out = []
    for n in (3, 5, 8, 20, 60, 120, 300, 1200):
        for _ in range(5):
            base = [rnd.choice(words) for _ in range(n)] + (passage if rnd.random() < 0.5 else [])
            out.append(base)
            for share in (0.01, 0.02, 0.03, 0.04, 0.06):
                copy = list(base)
                for k in rnd.sample(range(len(copy)), max(1, round(share * len(copy)))):
                    copy[k] = rnd.choice(words)
                out.append(copy)
    rnd.shuffle(out)
    return [" ".join(t) for t in out]


def test_near_copies_are_those_of_brute_force(spark, docs):
    rows = list(enumerate(texts()))
    want = groups([t for _, t in rows])
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(*rows)).collect()}
    assert got == dict(enumerate(want))
    kept = cp.simhash_dedup(spark, docs(*rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, g in enumerate(want) if i == g]


def test_dense_groups(docs):
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(f"x{rnd.random()}" if k == i % 100 else w for k, w in enumerate(base))) for i in range(400)]
    assert {r.component_id for r in near_copies.near_copies(docs(*rows)).collect()} == {0}


def test_edges(docs):
    rows = [r for r in EDGES if r[0] is not None]
    want = groups([t for _, t in rows])
    got = sorted((r.doc_id, r.component_id) for r in near_copies.near_copies(docs(*rows)).collect())
    assert got == sorted((i, min(rows[k][0] for k in range(len(rows)) if want[k] == g)) for (i, _), g in zip(rows, want))
    assert near_copies.near_copies(docs()).count() == 0


def test_fingerprint_is_that_of_simhash():
    for _, t in EDGES:
        assert near_copies.simhash_of(near_copies.shingle_hashes(t or "")) == simhash.fingerprint(t or "", 5)


def test_proposals_of_one_shingle():
    rng = np.random.default_rng(0)
    n = np.sort(rng.integers(5, 40, 60))
    at, component = np.zeros(60, dtype=int), rng.integers(0, 5, 60)
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if n[i] >= 0.8 * n[j] - 1e-9 and component[i] != component[j]}
    got = [(int(i), int(j)) for a, b in near_copies.propose(n, at, component, 0.8, most=50) for i, j in zip(a, b)]
    assert sorted(got) == sorted(want)


def test_parities_rule_out_no_pair_that_is_similar_and_most_others(spark, docs):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    rows = []
    for i, n in enumerate((1, 2, 9, 40, 400, 900) * 3):
        other = base[:n].copy()
        other[: n * (i // 6) // 12] ^= np.uint64(1 << 60)  # none, a twelfth, a sixth of the shingles differ
        rows.append(np.unique(other))
    sets = spark.createDataFrame([(i, len(s), near_copies.parity(s)) for i, s in enumerate(rows)], "node long, n int, bits binary")
    pairs = list(itertools.combinations(range(len(rows)), 2))
    similar = {(a, b) for a, b in pairs if len(np.intersect1d(rows[a], rows[b])) >= 0.8 * len(np.union1d(rows[a], rows[b])) - 1e-9}
    left = {tuple(r) for r in near_copies.likely(spark.createDataFrame(pairs, "a long, b long"), sets, 0.8).collect()}
    assert similar <= left and len(left) < len(similar) + len(pairs) // 10


def test_shingles_that_the_sample_does_not_show_are_counted_in_prefixes(docs, monkeypatch):
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"{i}x{rnd.random()}" for _ in range(60)) + " " + passage) for i in range(60)] + [(99, passage + " q"), (98, passage)]
    want = {i: 98 if i == 99 else i for i, _ in rows}
    proposed = []
    likely = near_copies.likely
    monkeypatch.setattr(near_copies, "likely", lambda pairs, *rest: proposed.append(pairs.count()) or likely(pairs, *rest))
    monkeypatch.setattr(near_copies, "HOT", 10)
    monkeypatch.setattr(near_copies, "FREQUENT", 1000)  # the sample shows nothing
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs(*rows)).collect()} == want
    assert sum(proposed) < 60


def test_few_sets_are_handed_over_at_once(spark, docs, monkeypatch):
    seen = []
    likely = near_copies.likely
    monkeypatch.setattr(near_copies, "likely", lambda *a: seen.append(spark.conf.get(session.BATCH_ROWS)) or likely(*a))
    before = spark.conf.get(session.BATCH_ROWS)
    near_copies.near_copies(docs((1, "a b c d e f"), (2, "a b c d e f")))
    assert set(seen) == {str(near_copies.SETS_AT_ONCE)} and spark.conf.get(session.BATCH_ROWS) == before
