"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors (`pivots` of them, those with the smallest hashes of id and vector). Every
vector is indexed: it is represented by the list of its `prefix` nearest pivots in order. Within a block of vectors each
pivot has an inverted file of (vector, place in its list). A query ranks a block's vectors by footrule distance, the sum
over its own pivots of the difference in places (a pivot that is missing has the place behind the last), which it adds
up from its pivots' files; the best are reranked by the exact inner product in double precision.

How many are reranked grows with the root of the number of vectors (`effort` times it, dealt over the blocks), and all
are where there are fewer. Vectors are dealt to blocks and go there once; only queries go to every block, behind its vectors,
as a stream, so that a task holds a block of vectors and a batch of queries. Recall is measured against brute force in
the tests.

Defined cases: vectors that are null, empty, all zero, hold null or non-finite components, or differ in length from the
most common length take no part, nor does a null id; ties go to the smaller id; a row's own id is never its neighbour
(rows that repeat an id are neighbours of others each, and as queries have a list of k each, with ranks from 1, under
the same query_id); with fewer than k others, all are returned; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.session import materialise, ship_package

SCHEMA = "query_id long, rank int, vec_id long, score double"


def clean_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of doubles), of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.where((F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The prefix nearest pivots of each row, nearest first; distances are those of directions, ties go to the first."""
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
    prefix = min(prefix, near.shape[1])
    part = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
    part.sort(axis=1)
    order = np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1).astype(np.int16)


class Block:
    """The inverted files of one block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, perms: np.ndarray, pivots: int):
        self.ids, self.x, self.n, self.prefix = ids, x, len(ids), perms.shape[1]
        flat = perms.ravel()
        order = np.argsort(flat, kind="stable")
        self.vector = (order // self.prefix).astype(np.int32)
        self.place = (order % self.prefix).astype(np.int32)
        self.bounds = np.searchsorted(flat[order], np.arange(pivots + 1))

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        m = self.prefix
        total = np.full(self.n, int((m - np.arange(m)).sum()), dtype=np.int32)
        for rank, p in enumerate(perm):
            a, b = self.bounds[p], self.bounds[p + 1]
            total[self.vector[a:b]] += np.abs(self.place[a:b] - rank) - (m - rank)
        return total

    def search(self, query_id: int, q: np.ndarray, perm: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of the reranked share."""
        most = min(self.n, max(2 * k, math.ceil(share * self.n)))
        at = np.arange(self.n)
        if most < self.n:
            far = self.footrule(perm)
            at = np.flatnonzero(far <= np.partition(far, most - 1)[most - 1])  # with all ties
        at = at[self.ids[at] != query_id]
        # Summed row by row, so that equal vectors have equal scores.
        score = (self.x[at] * q).sum(axis=1)
        best = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at][best], score[best]


def nearest(df: DataFrame, every: int = 20, k: int = 20, pivots: int = 512, prefix: int = 128, effort: float = 22.0, block: int = 32_768, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of every row whose id is divisible by `every`: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    ship_package(spark)
    rows = clean_vectors(df, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    dim, n = common["dim"], common["count"]
    rows = rows.where(F.size("v") == dim)
    sample = rows.select("v").orderBy(F.xxhash64("vec_id", "v"), "v").limit(pivots).collect()
    points = np.unique(np.array([r["v"] for r in sample]), axis=0)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    n_blocks = max(1, math.ceil(n / block))
    share = min(1.0, effort * math.sqrt(n) / n)

    def index(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                x = np.ascontiguousarray(part["v"].flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
                perms = permutations(x, points, prefix)
                cols = [part["vec_id"], pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in perms], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "perm"])

    # The index: every row, in the shared folder.
    indexed = rows.mapInArrow(index, "vec_id long, v binary, perm binary").withColumn("query_row", F.monotonically_increasing_id())
    table = materialise(indexed, "permutation-index")
    deal = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int")
    # Vectors go to their block, once; only queries go to every block, and pass it as a stream behind its vectors.
    vectors = table.select(deal.alias("block"), F.lit(False).alias("asks"), "vec_id", "v", "perm", F.lit(None).cast("long").alias("query_row"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    queries = table.where(F.col("vec_id") % every == 0).select(blocks.alias("block"), F.lit(True).alias("asks"), "vec_id", "v", "perm", "query_row")
    n_pivots = len(points)

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lambda col, kind: np.frombuffer(b"".join(col.to_pylist()), dtype=kind).reshape(len(col), -1)
        now, held, built = None, [], None
        for part in parts:
            number, asks = part["block"].to_numpy(), part["asks"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1).tolist(), part.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                rows = part.slice(a, b - a)
                if number[a] != now:
                    now, held, built = number[a], [], None
                ids, v, perm = rows["vec_id"].to_numpy(), load(rows["v"], np.float64), load(rows["perm"], np.int16)
                if not asks[a]:
                    held.append((ids, v, perm))
                    continue
                if built is None and held:
                    built = Block(*(np.concatenate(x) for x in zip(*held)), n_pivots)
                    held = []
                if built is None:
                    continue
                found = [built.search(i, q, p, k, share) for i, q, p in zip(ids, v, perm)]
                counts = [len(x) for x, _ in found]
                again = lambda x: pa.array(np.repeat(x, counts))
                columns = [again(rows["query_row"].to_numpy()), again(ids), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([x for _, x in found]))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_row", "query_id", "vec_id", "score"])

    dealt = vectors.unionByName(queries).repartition("block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(search, "query_row long, query_id long, vec_id long, score double")
    # At most k rows per query and block meet here.
    best = found.groupBy("query_row", "query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("i", "x"))
    return ranked.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))
