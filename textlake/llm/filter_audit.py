"""Filter interaction audit: what each filter removes in each order in which the filters may be applied.

A document's failures are a mask, one bit a filter. Documents are counted by part and mask (with those of good and of toxic
label) before anything else, so all that follows is as small as the parts are many. These cells are unpivoted against
the steps of all orders; a running bit-or window over a cell's steps in an order tells what the cell had failed before; sums
over the cells of a part and step give the metrics, and a window over all orders and steps of a filter its total.

The filters are expressions but for E, which asks whether a smaller doc_id has the same text: texts are told apart by their
SHA-256; the smallest id of each digest is a map-side combined aggregate, and only digests that occur again are joined back,
to rows of id and digest, which Spark can split where one text is very frequent.

Defined cases: a null text counts as empty, a null lang as the empty string; a null doc_id is smaller than none and has none
smaller, and has no labels; rows that repeat an id are counted each, and are no smaller than each other; labels that
repeat a doc_id count as good (toxic) if any of them says so; a part all of whose documents pass has rows of zeros; an empty
table gives an empty result; texts of any length are judged whole; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import UPPER, text_or_empty
from textlake.session import materialise

WORDS = "[\\x20\\x09-\\x0D]+"
#: The filters by letter; each is a condition of failure on the columns text and words. E, on the whole table, is added below.
ON_TEXT = {
    "A": lambda text, words: F.size(words) < 100,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
    "C": lambda text, words: 100 * (F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))) > 10 * F.char_length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
COPY = "E"
METRICS = ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def bits(names: str) -> dict[str, int]:
    return {f: 1 << k for k, f in enumerate(names)}


def failures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask of every row: the sum of the bits of the filters that it fails."""
    bit = bits("".join(ON_TEXT) + COPY)
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_or_empty(text_col).alias("text"),
    )
    rows = rows.withColumn("words", F.array_remove(F.split("text", WORDS), ""))
    mask = sum((F.when(fails(F.col("text"), F.col("words")), bit[f]).otherwise(0) for f, fails in ON_TEXT.items()), F.lit(0))
    rows = materialise(rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(copy, bit[COPY]).otherwise(0)).alias("mask"))


def cells(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the counts n, good, toxic of documents with it. labels: doc_id, quality, toxic."""
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("is_good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("is_toxic")
    )
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long"))
    return marked.join(told, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), total(F.col("is_good")).alias("good"), total(F.col("is_toxic")).alias("toxic"))


def order_steps(counted: DataFrame, filters: str) -> DataFrame:
    """Cells in long form: one row for each order and step, with the step's filter and bit."""
    orders = F.lit(",".join(map("".join, permutations(filters))))
    long = counted.select("*", F.explode(F.split(orders, ",")).alias("filter_order"))
    long = long.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    return long.withColumn("step", F.col("at") + 1).withColumn("bit", F.expr(f"shiftleft(1, locate(filter, '{filters}') - 1)"))


def audit(counted: DataFrame, filters: str) -> DataFrame:
    """The metrics of every part, order and step, from cells()."""
    long = order_steps(counted, filters)
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("failed", F.col("mask").bitwiseAND(F.col("bit"))).withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, alive = F.col("failed") != 0, F.col("earlier") == 0
    counted_if = lambda cond, value="n": F.sum(F.when(cond, F.col(value)).otherwise(F.lit(0).cast("long")))
    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        counted_if(alive & ~fails).alias("kept"),
        counted_if(alive & fails).alias("removed"),
        counted_if(~alive & fails).alias("redundant"),
        counted_if(F.col("mask") == F.col("bit")).alias("unique_fails"),
        counted_if(alive & fails, "good").alias("good_lost"),
        counted_if(alive & fails, "toxic").alias("toxic_lost"),
    )
    everywhere = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return steps.withColumn("shapley", everywhere).select("part", "filter_order", "step", "kept", *METRICS, "shapley")


def filter_audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit(cells(failures(df, id_col, text_col, part_col), labels), "".join(ON_TEXT) + COPY)
