"""Exact dedup: tree-merge of sorted runs of digests.

Every input partition makes a run: its digests in ascending order, cut into ranges of the digest, each an array of entries in
one row. Equal digests of a run are one entry with the id to keep and their number, however hot a text is. In a round
the runs of `fan_in` neighbours meet, range by range; their arrays, each sorted already, are merged into one, in which equal
digests are neighbours again and become one entry. Ranges are halved as runs are joined, so arrays stay as long as those
of the first runs, and the last level, a single run, is dealt over as many rows as all of them had. There are
ceil(log(partitions) / log(fan_in)) rounds, and one exchange before them that forms the runs.

All of it is array functions over collected rows: sort_array is a merge sort that takes over runs which are in order, so
merging costs one comparison or two an entry; no plan sorts behind an exchange.

A digest stands for a text through SHA-256 and is verified at every level by the text's length and by an independent
64-bit hash, which belong to the key of an entry: texts that differ in any of them are never merged.

Defined cases: a null text counts as empty; repeated ids are rows of their own; of rows with a null id none is preferred to one
that has an id, and a row with a null id stays only if all of its group have none; an empty table gives an empty
result; ties cannot occur but for repeated ids, where every row with the kept id is marked as kept; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import ascii_lower, documents
from textlake.session import materialise

KEY = ["digest", "n_bytes", "check"]
#: Entries of a run in a range of digests, about.
RANGE_ROWS = 4_096
#: Bits of a digest by which entries are ordered first, and dealt.
BITS = 56


def digest_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, run (its input partition), digest, n_bytes, check."""
    norm = documents(df, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    return norm.select(
        "doc_id",
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("check"),
    )


def _same(x: Column, y: Column) -> Column:
    return (x["prefix"] == y["prefix"]) & (x["digest"] == y["digest"]) & (x["n_bytes"] == y["n_bytes"]) & (x["check"] == y["check"])


def merged(runs: Column) -> Column:
    """One run of several, all sorted and one after the other in an array: entries with equal keys become the first of
    them, which has the id to keep, with the sum of their numbers."""

    def combine(run: Column) -> Column:
        n = F.size(run)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~_same(F.get(run, i), F.get(run, i - 1)))
        return F.element_at(F.transform(F.array(starts), lambda at: F.transform(at, lambda i, j: entry(run, i, F.coalesce(F.get(at, j + 1), n)))), 1)

    def entry(run: Column, i: Column, end: Column) -> Column:
        first = F.get(run, i)
        # Most entries stand alone.
        total = F.when(end - i == 1, first["rows"]).otherwise(F.aggregate(F.slice(run, i + 1, end - i), F.lit(0).cast("long"), lambda acc, x: acc + x["rows"]))
        return F.struct(*[first[c].alias(c) for c in ("prefix", *KEY, "no_id", "place")], total.alias("rows"))

    return F.element_at(F.transform(F.array(F.sort_array(runs)), combine), 1)


def merge_runs(runs: DataFrame, n_runs: int, fan_in: int = 4, keep: str = "max", rows_per_run: int = 0, least: int = 1) -> DataFrame:
    """Merge runs of (run, digest, n_bytes, check, doc_id) until one is left: a row per text of at least `least` rows, with
    keep_id and group_size."""
    place = {"min": F.col("doc_id"), "max": F.bitwise_not("doc_id")}[keep]  # descending, and without overflow
    prefix = F.conv(F.rpad(F.hex(F.substring("digest", 1, BITS // 8)), BITS // 4, "0"), 16, 10).cast("long")
    entries = F.struct(prefix.alias("prefix"), *KEY, F.col("doc_id").isNull().alias("no_id"), place.alias("place"), F.lit(1).cast("long").alias("rows"))
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, rows_per_run / RANGE_ROWS)))))
    of_bits = lambda x, b: F.shiftright(x, BITS - b) if b else F.lit(0).cast("long")
    level = runs.select("run", entries.alias("x")).select("run", of_bits(F.col("x.prefix"), bits).alias("range"), "x")
    level = level.groupBy("run", "range").agg(F.collect_list("x").alias("runs")).select("run", "range", merged(F.col("runs")).alias("entries"))
    left, halvings = max(1, n_runs), max(1, math.ceil(math.log2(fan_in)))
    while left > 1:
        left = -(-left // fan_in)
        old, bits = bits, min(BITS, bits + halvings)
        parts = 1 << (bits - old)
        cut = lambda s, old=bits - (bits - old), new=bits: F.struct(
            (F.col("range") * (1 << (new - old)) + s).alias("range"), F.filter("entries", lambda x: of_bits(x["prefix"], new) == F.col("range") * (1 << (new - old)) + s).alias("entries")
        )
        halves = F.array(*[cut(s) for s in range(parts)])
        level = level.select(F.floor(F.col("run") / fan_in).cast("int").alias("run"), F.explode(F.filter(halves, lambda h: F.size(h["entries"]) > 0)).alias("h"))
        level = level.groupBy("run", "h.range").agg(F.collect_list("h.entries").alias("runs")).select("run", "range", merged(F.flatten("runs")).alias("entries"))
    found = level.select(F.explode(F.filter("entries", lambda x: x["rows"] >= least)).alias("x"))
    keep_id = F.when(~F.col("x.no_id"), F.col("x.place") if keep == "min" else F.bitwise_not("x.place"))
    return found.select(*[F.col(f"x.{c}").alias(c) for c in KEY], keep_id.alias("keep_id"), F.col("x.rows").alias("group_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = 4) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; of equal texts the row with the `keep` id stays.

    Only texts that occur more than once go through the join back; its skewed side is what Spark can split at run time.
    """
    runs = materialise(digest_runs(df, id_col, text_col), "digest-runs")
    n_runs, n_rows = runs.agg(F.coalesce(F.max("run"), F.lit(0)) + 1, F.count("*")).first()
    copies = materialise(merge_runs(runs, n_runs, fan_in, keep, n_rows / n_runs, least=2), "copies")
    joined = runs.join(copies, KEY, "left")
    again = F.col("group_size").isNotNull()
    keep_id = F.when(again, F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
