"""Detection and conversion of encodings, and encoding for writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions import charset
from textlake.sources import ranges


def detect_encoding(files: DataFrame, mode: str = "sample") -> DataFrame:
    """path, encoding, confidence, has_bom."""
    rows = files.withColumn("d", charset.detect(F.col("content"), mode))
    return rows.select("path", F.col("d.charset").alias("encoding"), F.col("d.confidence").alias("confidence"), F.col("d.has_bom").alias("has_bom"))


def chunk_votes(files: DataFrame) -> DataFrame:
    """path, charset, confidence, weight of each chunk: large files are cut into rows, so that no task detects a whole
    file; charset.vote() adds them up."""
    size = F.octet_length("content")
    cut = files.select("path", "content", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), size - 1), F.lit(charset.CHUNK))).alias("at"))
    chunks = cut.select("path", F.substring("content", F.col("at") + 1, F.lit(charset.CHUNK)).alias("chunk"))
    found = chunks.select("path", F.octet_length("chunk").cast("long").alias("weight"), charset.detect(F.col("chunk"), "full").alias("d"))
    return found.select("path", "d.charset", "d.confidence", "weight")


def range_votes(files: DataFrame, size: int = charset.CHUNK) -> DataFrame:
    """path, charset, confidence, weight of each range of files (path, size), which are read by ranges, so that no row holds
    a file, however large; charset.vote() adds them up."""
    rows = ranges.with_bytes(ranges.ranges(files.select("path", "size"), size)).where("content is not null")
    found = rows.select("path", F.octet_length("content").cast("long").alias("weight"), charset.detect(F.col("content"), "full").alias("d"))
    return found.select("path", "d.charset", "d.confidence", "weight")


def convert_encoding(files: DataFrame, to: str, source: str | None = None) -> DataFrame:
    """path, source, target, new_content, error, error_code."""
    target = charset.require(to)
    rows = charset.with_text(files.select("path", "content"), "convert", source)
    rows = rows.withColumn("b", charset.encode_text(F.when(F.col("e.error").isNull(), F.col("text")), target.name))
    error = F.coalesce("e.error", "b.error")
    name = F.lit(source.lower()) if source else F.col("e.name")
    return rows.select("path", name.alias("source"), F.lit(target.name).alias("target"), F.when(error.isNull(), F.col("b.content")).alias("new_content"), error.alias("error"), F.when(error.isNotNull(), "ENCODING").alias("error_code"))


def encode_for_write(texts: DataFrame, existing: DataFrame | None = None, encoding: str | None = None, default: str = "windows-1251") -> DataFrame:
    """From (path, text) to path, encoding, new_content, error. Without an encoding an existing file keeps its own."""
    if encoding:
        rows = texts.withColumn("name", F.lit(charset.require(encoding).name))
    elif existing is None:
        rows = texts.withColumn("name", F.lit(charset.require(default).name))
    else:
        found = existing.select("path", charset.resolve(F.col("content"), "write", default=default)["name"].alias("found"))
        rows = texts.join(found, "path", "left").withColumn("name", F.coalesce("found", F.lit(charset.require(default).name)))
    rows = rows.withColumn("b", charset.encode_text(F.col("text"), encoding or F.col("name")))
    return rows.select("path", F.col("name").alias("encoding"), F.col("b.content").alias("new_content"), F.col("b.error").alias("error"))
