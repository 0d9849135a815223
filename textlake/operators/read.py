"""Reading text: decode, slice by lines, cap by characters; single files and request lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions import charset, text


def read_text(files: DataFrame, encoding: str | None = None, offset: int | None = None, limit: int | None = None, max_characters: int | None = None) -> DataFrame:
    """path, content, total_lines, file_size_bytes, start_line, end_line, truncated, detected_encoding, confidence.

    Lines are sliced first, then characters capped; totals are of the whole file. An offset behind the end gives an
    empty content with start total + 1 and end total. With an explicit encoding the detection columns are null.
    """
    rows = charset.with_text(files.where("content is not null").select("path", "content"), "read", encoding)
    rows = rows.select("path", "text", F.octet_length("content").cast("long").alias("file_size_bytes"), F.col("e.label").alias("detected_encoding"), F.col("e.confidence").alias("confidence"))
    rows = rows.withColumn("total_lines", text.total_lines(F.col("text")))
    skip = offset - 1 if offset and offset > 1 else 0
    total = F.col("total_lines")
    start = F.least(F.lit(skip + 1).cast("long"), total + 1)
    end = F.least(F.lit(skip + limit).cast("long"), total) if limit and limit > 0 else total
    part = F.col("text")
    if skip or (limit and limit > 0):
        n = F.greatest(end - start + 1, F.lit(0)).cast("int")
        part = F.array_join(F.slice(text.split_lines(F.col("text")), start.cast("int"), n), "\n")
    rows = rows.select("*", part.alias("part"), start.alias("start_line"), end.alias("end_line"))
    content, cut = F.col("part"), F.lit(False)
    if max_characters and max_characters > 0:
        cut = F.char_length("part") > max_characters
        notice = text.truncation_notice(max_characters, F.col("total_lines"), F.col("file_size_bytes"))
        content = F.when(cut, F.concat(F.substring("part", 1, max_characters), notice)).otherwise(content)
    return rows.select("path", content.alias("content"), "total_lines", "file_size_bytes", "start_line", "end_line", cut.alias("truncated"), "detected_encoding", "confidence")


def stats(files: DataFrame) -> DataFrame:
    """path, total_lines, n_chars, file_size_bytes of UTF-8 files."""
    t = F.col("content").cast("string")
    return files.select("path", text.total_lines(t).alias("total_lines"), F.char_length(t).cast("long").alias("n_chars"), F.octet_length("content").cast("long").alias("file_size_bytes"))


def read_multiple(requests: DataFrame, files: DataFrame, encoding: str | None = None, allowed: list[str] | None = None) -> DataFrame:
    """A row per request (idx, path), in its place: content, error, error_code, detected_encoding, confidence.

    Errors belong to their own rows: no path, with `allowed` a path outside those folders or (if files has real_path) a
    link that leads out of them, a path that files lacks, and files without content, whose error and error_code, as
    with_content() gives them, pass through.
    """
    from textlake.functions.policy import path_allowed

    own = lambda name, kind: F.col(name) if name in files.columns else F.lit(None).cast(kind)
    escaped = ~path_allowed(F.col("real_path"), allowed) if allowed is not None and "real_path" in files.columns else F.lit(False)
    known_code = F.coalesce(own("error_code", "string"), F.when(F.col("content").isNull(), "IO_ERROR"))
    known = files.select("path", "content", own("error", "string").alias("why"), known_code.alias("known_code"), F.coalesce(escaped, F.lit(False)).alias("escaped"))
    # The only join: texts are decoded behind it, so that bytes which nobody asked for are not.
    rows = charset.with_text(requests.select("idx", "path").join(known, "path", "left"), "read", encoding)
    rows = rows.select("idx", "path", F.col("text").alias("content"), F.col("e.label").alias("detected_encoding"), F.col("e.confidence").alias("confidence"), "why", "known_code", "escaped")
    denied = ~path_allowed(F.col("path"), allowed) if allowed is not None else F.lit(False)
    code = F.when(F.coalesce(F.col("path"), F.lit("")) == "", "INVALID_PATH").when(denied, "ACCESS_DENIED").when(F.col("escaped"), "SYMLINK_ESCAPE").when(F.col("known_code").isNotNull(), F.col("known_code")).when(F.col("content").isNull(), "NOT_FOUND")
    rows = rows.withColumn("error_code", code)
    said = F.when(F.col("error_code") == "SYMLINK_ESCAPE", "link leads out of the allowed folders").when(F.col("error_code").isin("PERMISSION", "IO_ERROR", "ENCODING"), F.coalesce("why", F.lit("failed to read file")))
    message = F.when(F.col("error_code") == "INVALID_PATH", "path is required").when(F.col("error_code") == "ACCESS_DENIED", "access denied").when(F.col("error_code") == "NOT_FOUND", "file not found").otherwise(said)
    ok = F.col("error_code").isNull()
    return rows.select("idx", "path", F.when(ok, F.col("content")).alias("content"), message.alias("error"), "error_code", F.when(ok, F.col("detected_encoding")).alias("detected_encoding"), F.when(ok, F.col("confidence")).alias("confidence"))


def read_paths(spark: SparkSession, paths: list[str], encoding: str | None = None, allowed: list[str] | None = None) -> DataFrame:
    """read_multiple() for a list of files, in their order; no path at all is an error of the call."""
    from textlake.sources.files import with_content

    if not paths:
        raise ValueError("paths are required")
    asked = spark.createDataFrame(list(enumerate(paths)), "idx long, path string")
    return read_multiple(asked, with_content(asked.select("path").distinct()), encoding, allowed)


def read_summary(results: DataFrame) -> DataFrame:
    """One row: success_count, error_count, errors (path: message, in order of request)."""
    listed = F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("idx", F.concat(F.coalesce("path", F.lit("")), F.lit(": "), "error").alias("m")))))
    return results.agg(F.count_if(F.col("error_code").isNull()).alias("success_count"), F.count_if(F.col("error_code").isNotNull()).alias("error_count"), F.transform(listed, lambda x: x["m"]).alias("errors"))
