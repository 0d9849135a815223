"""Links as a graph: where each leads in the end, which go round in circles, and which leave the allowed folders.

A link is a row of path and target. Chains are followed by pointer doubling: every round each link takes over where its
target leads, so a chain of n links is done in log n rounds, each an equi-join of the links with themselves. What still
leads to a link after as many rounds as a chain of all links would need is on a circle, or leads into one.

Defined cases: a target that is no link of the table is where a chain ends, be it there or not; a link to itself is a
circle; rows that repeat a path count as one, with the target that is least; null paths and targets take no part; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions.policy import path_allowed
from textlake.session import discard, materialise


def follow(links: DataFrame) -> DataFrame:
    """path, real_path, hops of every link; both are null for links that end nowhere."""
    once = links.where("path is not null and target is not null").groupBy("path").agg(F.min("target").alias("target"))
    now = materialise(once.select("path", F.col("target").alias("to"), F.lit(1).cast("long").alias("hops"), F.lit(True).alias("open")), "links")
    n = now.count()
    for _ in range(math.ceil(math.log2(n + 1)) + 1 if n else 0):
        # Links that have arrived are not asked again, and lead nowhere further.
        ahead = now.select(F.col("path").alias("to"), F.col("to").alias("then"), F.col("hops").alias("more"), F.col("open").alias("goes_on"))
        moved = now.where("open").join(ahead, "to", "left")
        moved = moved.select("path", F.coalesce("then", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("goes_on", F.lit(False)).alias("open"))
        new = materialise(now.where("not open").unionByName(moved), "links")
        discard(now)
        now = new
        if not now.where("open").limit(1).count():
            break
    end = lambda c: F.when(~F.col("open"), F.col(c))
    return now.select("path", end("to").alias("real_path"), end("hops").alias("hops"))


def resolve_links(links: DataFrame, allowed: list[str]) -> DataFrame:
    """path, real_path, hops, error_code: SYMLINK_ESCAPE for links that lead out of the allowed folders, IO_ERROR for circles."""
    code = F.when(F.col("real_path").isNull(), "IO_ERROR").when(~path_allowed(F.col("real_path"), allowed), "SYMLINK_ESCAPE")
    return follow(links).select("path", "real_path", "hops", code.alias("error_code"))
