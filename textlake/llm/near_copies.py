"""Near copies by verified Jaccard similarity of word shingles: all pairs of `least` or more, none below.

SimHash proposes first: fingerprints of the same shingles go through the trie join, which finds dense groups cheaply but
only part of the pairs of 0.8. An exact set-similarity join proposes the rest: shingles are ordered from rare to common, and two
sets that are similar share one of the first n - ceil(least * n) + 1. The order is total: how often a shingle occurs in a
bounded sample of the sets, if it is frequent there, then its hash. Shingles that turn out to be in the prefixes of many sets,
though the sample did not show them, are counted there exactly, and the prefixes are made anew by these counts. The order
decides how many pairs are proposed, not which are found. Pairs are filtered by length and position, then by the parities of
their sets: 2,048 bits, each telling whether an odd number of shingles falls to it, differ in no more bits than the sets
differ in shingles. Only pairs that this does not rule out carry their whole sets, by which they are verified.

Only connectivity is asked for. So a shared shingle first proposes a chain and a star of its sets; after these are
verified and joined to components, it proposes every other pair that is still in two components. Dense groups of near
copies therefore cost about as much as sparse ones.

Defined cases: texts with fewer words than a shingle are one shingle; texts without words, or null, are copies of each
other; equal sets are one node, so exact copies cost nothing; repeated ids are rows of their own; an empty table gives
an empty result. Shingles and sets stand for themselves through 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import documents, text_slices, trim
from textlake.llm.components import connected_components
from textlake.llm.simhash import SEED, near_links
from textlake.session import batches_of, discard, materialise, ship_package

#: The sample of sets in which frequent shingles are looked for (so many sets and so many shingles at most), how often they must
#: occur there, and how many there are at most.
SAMPLE_SETS, SAMPLE_SHINGLES, FREQUENT, MOST_FREQUENT = 40_000, 20_000_000, 3, 200_000
#: A shingle that is in more prefixes than this is counted exactly if the sample has not shown it.
HOT = 100
#: As many rows, each with a whole set, are handed to a Python worker at once.
SETS_AT_ONCE = 1_000
#: As many tasks at least count the sample's shingles, most of which occur once.
COUNTERS = 64
#: The bits of a set's parity, a power of two; and the nodes that are sent to all tasks at most, beyond which they are joined by exchange.
PARITY_BITS, BROADCAST_ROWS = 2_048, 1_000_000


def shingle_hashes(text: str, words: int = 5) -> np.ndarray:
    """Hashes of all shingles in order, unsigned."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split()
    if len(parts) <= words:
        return np.array([xxh64_intdigest(b" ".join(parts), SEED)] if parts else [], dtype=np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - words + 1]
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())), dtype=np.uint64, count=len(starts))


def simhash_of(hashes: np.ndarray) -> int:
    """As simhash.fingerprint: a bit is set if it is set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 100_000):
        ones += np.unpackbits(hashes[i : i + 100_000].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each value of the hashes' first bits: whether an odd number of hashes has it."""
    at = (shingles >> np.uint64(64 - (PARITY_BITS.bit_length() - 1))).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITY_BITS) & 1).astype(np.uint8)).tobytes()


def shingle_sets(df: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node (a hash of the set), fp, n, bits (its parity), shingles (the sorted set, as bytes); a row per document."""
    from xxhash import xxh64_intdigest

    ship_package(df.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(parts):
            hashes = [shingle_hashes(t, words) for t in texts]
            sets = [np.unique(h) for h in hashes]
            node = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            fp = np.array([simhash_of(h) for h in hashes], dtype=np.uint64).view(np.int64)
            n = np.array([len(s) for s in sets], dtype=np.int32)
            bits, whole = pa.array([parity(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(node), pa.array(fp), pa.array(n), bits, whole], names=["doc_id", "node", "fp", "n", "bits", "shingles"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, node long, fp long, n int, bits binary, shingles binary")


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of many sets in a bounded sample, ascending, MOST_FREQUENT of them at most, and their counts in as many
    sets as the sample has."""

    def tokens(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, 500):
                flat = np.frombuffer(b"".join(part["shingles"].slice(i, 500).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat)], names=["token"])

    sampled = sets.where(F.pmod(F.xxhash64("node"), F.lit(sample_step(sets))) == 0).select("shingles").mapInArrow(tokens, "token long")
    # Dealt before they are counted: hardly any is in one task twice, so that counting there would only take memory.
    tasks = max(COUNTERS, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = sampled.repartition(tasks, "token").groupBy("token").count().where(F.col("count") >= FREQUENT)
    return most_frequent(counts)


def sample_step(sets: DataFrame) -> int:
    """One of so many sets is in the sample."""
    n, shingles = sets.agg(F.count("*"), F.sum(F.col("n").cast("long"))).first()
    return max(1, n // SAMPLE_SETS, -(-(shingles or 0) // SAMPLE_SHINGLES))


def most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = counts.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).collect()
    found = np.array([r["token"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r["count"] for r in rows], dtype=np.int64)[order]


def with_hot(frequent: tuple[np.ndarray, np.ndarray], shared: DataFrame, step: int) -> tuple[np.ndarray, np.ndarray] | None:
    """frequent with the shingles that more than HOT prefixes have, their counts brought to the sample's; None if there is nothing new."""
    found, counts = most_frequent(shared.groupBy("token").count().where(F.col("count") > HOT))
    new = ~np.isin(found, frequent[0])
    if not new.any():
        return None
    every, weight = np.concatenate([frequent[0], found[new]]), np.concatenate([frequent[1], np.maximum(1, counts[new] // step)])
    order = np.argsort(every)
    return every[order], weight[order]


def rarity(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The order of a set's shingles from rare to common: those that are not frequent first, ties by hash."""
    known, counts = frequent
    if not len(known):
        return np.argsort(h)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.lexsort((h, np.where(known[at] == h, counts[at], 0)))


def prefix_length(n: int, least: float) -> int:
    return n - int(np.ceil(least * n - 1e-9)) + 1


def propose(n: np.ndarray, at: np.ndarray, component: np.ndarray | None, least: float, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs among the sets that share one shingle, sorted by n; at is the shingle's place in each set.

    Without components a chain and a star, else every pair of two components.
    """
    m = len(n)

    def fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = np.minimum(n[a] - at[a], n[b] - at[b])  # at most: the rest of the shorter
        ok = (n[a] >= least * n[b] - 1e-9) & (shared * (1 + least) >= least * (n[a] + n[b]) - 1e-6)
        if component is not None:
            ok &= component[a] != component[b]
        return a[ok], b[ok]

    if component is None:
        i = np.arange(1, m)
        yield fit(np.concatenate([i - 1, np.zeros(max(0, m - 2), dtype=np.int64)]), np.concatenate([i, i[1:]]))
        return
    if (component == component[0]).all():
        return
    # Sets from i to stop[i] are not too long for set i.
    stop = np.searchsorted(n, (n + 1e-6) / least, side="right")
    count = np.maximum(stop - np.arange(m) - 1, 0)
    ends = np.cumsum(count)
    start = 0
    while start < m:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        of = np.repeat(np.arange(start, end), count[start:end])
        yield fit(of, of + 1 + np.arange(len(of)) - np.repeat(ends[start:end] - count[start:end] - base, count[start:end]))
        start = end


def _groups(parts: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """From rows sorted by token: the columns in pieces of whole groups."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for part in parts:
        if not part.num_rows:
            continue
        held.append(tuple(part[c].to_numpy(zero_copy_only=False) for c in columns))
        size += part.num_rows
        if size >= 200_000:
            cols = tuple(np.concatenate(x) for x in zip(*held))
            change = np.flatnonzero(cols[0][1:] != cols[0][:-1])
            if len(change):
                yield tuple(x[: change[-1] + 1] for x in cols)
                cols = tuple(x[change[-1] + 1 :] for x in cols)
            held, size = [cols], len(cols[0])
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))
    held.clear()
    trim()


def shared_prefixes(sets: DataFrame, frequent: tuple[np.ndarray, np.ndarray], least: float) -> DataFrame:
    """token, n, node, at: the places of prefix shingles that more than one set has, once per set."""

    def prefixes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows in (part.slice(i, 500) for i in range(0, part.num_rows, 500)):
                tokens, lengths = [], []
                for s in rows["shingles"]:
                    h = np.frombuffer(s.as_py(), np.uint64)
                    k = prefix_length(len(h), least) if len(h) else 0
                    tokens.append(h[rarity(h, frequent)[:k]])
                    lengths.append(k)
                if sum(lengths):
                    again = lambda name: np.repeat(rows[name].to_numpy(zero_copy_only=False), lengths)
                    place = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(again("n")), pa.array(again("node")), pa.array(place)], names=["token", "n", "node", "at"])

    def shared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, n, node, at in _groups(parts, ("token", "n", "node", "at")):
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])  # exact copies are one
            token, n, node, at = token[new], n[new], node[new], at[new]
            same = token[1:] == token[:-1]
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, n, node, at)], names=["token", "n", "node", "at"])

    schema = "token long, n int, node long, at int"
    rows = sets.select("n", "node", "shingles").where("n > 0").mapInArrow(prefixes, schema)
    return rows.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(shared, schema)


def proposals(shared: DataFrame, least: float) -> DataFrame:
    """Distinct pairs of nodes (a, b), a < b; of different components if shared has that column."""
    columns = tuple(shared.columns)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, n, node, at, *rest in _groups(parts, columns):
            cuts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]]).tolist()
            held, size = [], 0
            for i, j in zip(cuts, cuts[1:]):
                for a, b in propose(n[i:j], at[i:j], rest[0][i:j] if rest else None, least):
                    if len(a):
                        held.append((node[i:j][a], node[i:j][b]))
                        size += len(a)
                    if size > 500_000:
                        yield pairs(held)
                        held, size = [], 0
            if held:
                yield pairs(held)

    def pairs(held: list) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    dealt = shared.repartition("token").sortWithinPartitions("token", "n", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def sides(pairs: DataFrame, own: DataFrame, column: str) -> DataFrame:
    """a, b and the column's values of both, x and y. own: a row per node."""
    side = lambda node, name: own.select(F.col("node").alias(node), F.col(column).alias(name))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")


def likely(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets may have a Jaccard similarity of `least` or more, by what their parities tell."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows in (part.slice(i, 1000) for i in range(0, part.num_rows, 1000)):
                x, y = (rows[c].flatten() for c in ("x", "y"))
                n = sum(c[0].to_numpy(zero_copy_only=False).astype(np.int64) for c in (x, y))
                x, y = (np.frombuffer(b"".join(c[1].to_pylist()), np.uint64).reshape(rows.num_rows, -1) for c in (x, y))
                differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                ok = differ * (1 + least) <= (1 - least) * n + 1e-6
                if ok.any():
                    yield pa.RecordBatch.from_arrays([rows[c].filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    own = sets.groupBy("node").agg(F.first(F.struct("n", "bits")).alias("set"))
    return sides(pairs, own, "set").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of `least` or more; a table of its own."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ok = []
            for x, y in zip(part["x"], part["y"]):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            if any(ok):
                yield pa.RecordBatch.from_arrays([part[c].filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    left = materialise(likely(pairs, sets, least), "likely-pairs")
    needed = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if 2 * left.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)  # so that only the sets of these pairs are dealt
    own = sets.select("node", "shingles").join(needed, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    out = materialise(sides(left, own, "shingles").mapInArrow(run, "a long, b long"), "links")
    discard(left)
    return out


def near_copies(df: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id, the smallest doc_id that is reachable over pairs of near copies; a row without an id counts in its
    group, whose component_id it gets, and is the component itself (null) if none of the group has an id."""
    with batches_of(df.sparkSession, SETS_AT_ONCE):
        sets = materialise(shingle_sets(df, words, id_col, text_col), "shingle-sets")
        frequent = frequent_shingles(sets)
        shared = materialise(shared_prefixes(sets, frequent, least), "shared-shingles")
        if hot := with_hot(frequent, shared, sample_step(sets)):
            discard(shared)
            shared = materialise(shared_prefixes(sets, hot, least), "shared-shingles")

        nodes = sets.where("n > 0").select("fp", "node").distinct()
        reps = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
        same = nodes.join(reps, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
        hashed = same.union(near_links(reps)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        first = materialise(hashed.union(proposals(shared, least)).distinct(), "proposals")
        links = verified(first, sets, least)

        found = connected_components(links)
        placed = shared.join(found, "node", "left").select("token", "n", "node", "at", F.coalesce("component", "node").alias("component"))
        rest = materialise(proposals(placed, least).join(first, ["a", "b"], "left_anti"), "proposals")
        more = verified(rest, sets, least)
        found = connected_components(links.union(more))

        owned = sets.select("doc_id", "node").join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
        owned = materialise(owned, "near-copies")
        discard(sets, shared, first, links, rest, more)
    least_id = owned.groupBy("component").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")).where("rows > 1")
    return owned.join(least_id, "component", "left").select("doc_id", F.coalesce("least_id", "doc_id").alias("component_id"))
