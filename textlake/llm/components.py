"""Connected components of an edge table by alternating large-star and small-star steps.

Edges stay distributed and each step is one aggregation and one join; the loop ends when the edge set no longer changes
(compared by count and two order-free hashes). Every round is written to the shared folder, so lineage stays short and a
lost executor costs a stage, not the loop. Joins on a hub's key are plain equi-joins whose larger side Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.session import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """For every node, hang its larger neighbours on the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges go from larger to smaller; hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From edges (a long, b long) to (node, component) for every node with an edge to another; component is the
    smallest node of its component. Loops and repeated edges are allowed; no edges give an empty table."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))).first())

    now = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = state(now)
    for _ in range(most_rounds):
        new = materialise(_small_star(_large_star(now)).distinct(), "edges")
        discard(now)
        now, last, seen = new, seen, state(new)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
