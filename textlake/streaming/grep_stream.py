"""Incremental search: files that arrive in a folder, or rows of a table, are searched once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.operators.grep import GrepSpec, matches

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, path: str, glob: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """A stream of path and content; at most per_trigger files in a batch."""
    reader = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", str(per_trigger))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")


def grep_stream(files: DataFrame, spec: GrepSpec) -> DataFrame:
    """Matches of a stream of files; the plan is that of a batch, without order and limit."""
    return matches(files, spec)


def counts_per_file(found: DataFrame) -> DataFrame:
    """Running counts of matches by path, for update or complete mode."""
    return found.groupBy("path").agg(F.count("*").alias("n"))
