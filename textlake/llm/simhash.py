"""SimHash near-dedup by a binary trie self-join.

Fingerprints are computed in one pass over the texts and collapsed to distinct values, so groups of copies are single
leaves. Two fingerprints within k differing bits agree in at least one of k + 1 blocks of bits; with that block's bits
moved to the front, they lie in the same subtrie below it. Each subtrie is joined with itself: pairs of nodes descend
together, bit by bit, with the number of bits in which their paths differ, and a pair is dropped when that exceeds k.

Only connectivity is asked for. A subtrie therefore emits a spanning star of what it linked, never pairs: neighbours in
sorted order are linked first, and a pair of nodes whose leaves all are in one component already is dropped as well. So
dense groups of near copies cost about as much as sparse ones. Subtries with more leaves than `tile` are split in tiles
(by a hash of the fingerprint) which are joined pair by pair.

Defined cases: a null text, or one without words, has fingerprint zero and is linked like any other; texts with fewer
words than a shingle are one shingle; rows that repeat an id, or have none, are rows of their own and link like any other
(a null id is never a component's smallest, unless there is no other); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import documents, text_slices
from textlake.llm.components import connected_components
from textlake.session import discard, materialise, ship_package

SEED = 42


def fingerprint(text: str, words: int = 4) -> int:
    """64 bits, unsigned: a bit is set if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - words + 1]
    ends = ends[words - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), 100_000):
        pairs = zip(starts[i : i + 100_000].tolist(), ends[i : i + 100_000].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def fingerprints(df: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""
    ship_package(df.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(parts):
            fp = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(fp)], names=["doc_id", "fp"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def blocks(bits: int) -> list[tuple[int, int]]:
    """(shift from the top, width) of bits + 1 blocks of 64 bits."""
    cuts = [round(64 * i / (bits + 1)) for i in range(bits + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components of a[i] and b[i] in place; label holds each leaf's smallest known fellow."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def trie_links(group: np.ndarray, key: np.ndarray, skip: int, budget: int, most: int = 400_000) -> np.ndarray:
    """For leaves sorted by (group, key): the index of the smallest leaf that each is connected to.

    key: unsigned 64-bit, whose first `skip` bits are equal within a group.
    """
    n = len(key)
    label = np.arange(n)
    if n < 2:
        return label
    for d in (1, 2):
        near = np.flatnonzero((group[d:] == group[:-d]) & (np.bitwise_count(key[d:] ^ key[:-d]) <= budget))
        _settle(label, near, near + d)
    zeros: dict[int, np.ndarray] = {}

    def middle(bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the ones of this bit begin within each node."""
        if bit not in zeros:
            is_zero = (key >> np.uint64(63 - bit) & np.uint64(1)) == 0
            zeros[bit] = np.concatenate([[0], np.cumsum(is_zero)]).astype(np.int32)
        z = zeros[bit]
        return lo + (z[hi] - z[lo])

    def live(p: tuple) -> tuple:
        """Without pairs of which all leaves are in one component."""
        alo, ahi, blo, bhi, _ = p
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        done = (change[alo] == change[ahi - 1]) & (change[blo] == change[bhi - 1]) & (label[alo] == label[blo])
        return tuple(x[~done] for x in p)

    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    last = np.concatenate([first[1:], [n]])
    wide = last - first > 1
    lo, hi = first[wide], last[wide]
    stack = [(skip, (lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int8)))]
    while stack:
        bit, pairs = stack.pop()
        pairs = live(pairs)
        if len(pairs[0]) > most:
            half = len(pairs[0]) // 2
            stack += [(bit, tuple(x[:half] for x in pairs)), (bit, tuple(x[half:] for x in pairs))]
            continue
        alo, ahi, blo, bhi, err = pairs
        if not len(alo):
            continue
        few = ((ahi - alo) * (bhi - blo) <= 16) | (bit >= 64)
        if few.any():
            _leaves(label, key, budget, alo[few], ahi[few], blo[few], bhi[few], most)
            alo, ahi, blo, bhi, err = (x[~few] for x in pairs)
        if not len(alo):
            continue
        amid, bmid, own = middle(bit, alo, ahi), middle(bit, blo, bhi), alo == blo
        children = []
        for a0, a1, b0, b1, differ in ((alo, amid, blo, bmid, 0), (amid, ahi, bmid, bhi, 0), (alo, amid, bmid, bhi, 1), (amid, ahi, blo, bmid, 1)):
            keep = (a1 > a0) & (b1 > b0) & (err + differ <= budget)
            if differ and a0 is amid:
                keep &= ~own  # a node with itself: its two mixed pairs are the same
            keep &= ~((a0 == b0) & (a1 - a0 == 1))
            children.append(tuple(x[keep] for x in (a0, a1, b0, b1, err + np.int8(differ))))
        stack.append((bit + 1, tuple(np.concatenate(x) for x in zip(*children))))
    return label


def _leaves(label, key, budget, alo, ahi, blo, bhi, most) -> None:
    """Compare the leaves of small pairs of nodes, and of nodes with nothing left to descend."""
    na, size = ahi - alo, (ahi - alo) * (bhi - blo)
    bounds = np.concatenate([[0], np.cumsum(size)])
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + 8 * most, side="right")) - 1)
        s = size[start:stop]
        of = np.repeat(np.arange(start, stop), s)
        at = np.arange(len(of)) - np.repeat(bounds[start:stop] - bounds[start], s)
        a, b = alo[of] + at % na[of], blo[of] + at // na[of]
        hit = (a != b) & (np.bitwise_count(key[a] ^ key[b]) <= budget)
        _settle(label, a[hit], b[hit])
        start = stop


def near_links(reps: DataFrame, budget: int = 4, tile: int = 200_000) -> DataFrame:
    """From distinct fingerprints (fp, rep) to edges (a, b) between reps that connect what is within budget bits."""
    spark = reps.sparkSession
    ship_package(spark)
    spec = blocks(budget)
    turned = [F.expr(f"shiftleft(fp, {s}) | shiftrightunsigned(fp, {64 - s})") if s else F.col("fp") for s, _ in spec]
    one = [F.struct(F.lit(i).alias("block"), t.alias("key"), F.shiftrightunsigned(t, 64 - w).alias("front")) for i, (t, (_, w)) in enumerate(zip(turned, spec))]
    rows = reps.select("rep", F.explode(F.array(*one)).alias("x")).select("rep", "x.*")
    # As many rows as there are block values, so this table's size is bounded by the choice of blocks.
    big = rows.groupBy("block", "front").count().where(F.col("count") > tile).select("block", "front", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    rows = rows.join(F.broadcast(big), ["block", "front"], "left")
    mine = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.least(mine, j) * F.col("tiles") + F.greatest(mine, j))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(cells)))
    order = F.expr("key ^ shiftleft(1L, 63)")  # as unsigned integers sort
    dealt = rows.select("block", "front", "cell", "key", "rep").repartition("block", "front", "cell").sortWithinPartitions("block", "front", "cell", order)
    widths = [w for _, w in spec]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def linked(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            block, front, cell, key, rep = cols
            for i, w in enumerate(widths):
                at = np.flatnonzero(block == i)
                if len(at) < 2:
                    continue
                f, c = front[at], cell[at]
                group = np.cumsum(np.concatenate([[False], (f[1:] != f[:-1]) | (c[1:] != c[:-1])]))
                root = trie_links(group, key[at].view(np.uint64), w, budget)
                moved = np.flatnonzero(root != np.arange(len(at)))
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[at][moved]), pa.array(rep[at][root[moved]])], names=["a", "b"])

        def joined() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(x) for x in zip(*held))

        size = 0
        for part in parts:
            if not part.num_rows:
                continue
            held.append(tuple(part[c].to_numpy(zero_copy_only=False) for c in ("block", "front", "cell", "key", "rep")))
            size += part.num_rows
            if size >= 300_000:  # whole groups only
                cols = joined()
                change = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)
                ends = np.flatnonzero(change)
                if len(ends):
                    cut = ends[-1] + 1
                    yield from linked(tuple(x[:cut] for x in cols))
                    cols = tuple(x[cut:] for x in cols)
                held, size = [cols], len(cols[0])
        if held:
            yield from linked(joined())

    return dealt.mapInArrow(run, "a long, b long")


def simhash_groups(df: DataFrame, words: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that is reachable over links."""
    fps = materialise(fingerprints(df, words, id_col, text_col), "fingerprints")
    # Fingerprints are the nodes, whatever rows and ids have them.
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    found = connected_components(near_links(reps.select("fp", F.col("fp").alias("rep")), budget))
    placed = reps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("component"))
    placed = materialise(placed, "fingerprint-components")
    whole = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("copies").alias("members")).where("members > 1")
    # Fingerprints of one row and without links need no join. Written, so that Spark can split a hot fingerprint's rows.
    groups = materialise(placed.join(whole, "component").select("fp", "component_id"), "fingerprint-groups")
    discard(placed)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(groups, "fp", "left").select("doc_id", hexed.alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
