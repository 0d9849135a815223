"""Line ends: audit and conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions import charset, text


def detect_line_endings(files: DataFrame) -> DataFrame:
    """path, style, crlf, lf, total_lines, inconsistent_lines: in mixed files the lines that end otherwise than most.

    With equal counts CRLF is the rule. Works on bytes as they are, within the row.
    """
    t = files.select("path", F.col("content").cast("string").alias("t"))
    counted = t.select("path", "t", text.crlf_count(F.col("t")).alias("crlf"), text.lone_lf_count(F.col("t")).alias("lf"))
    crlf_rules = F.col("crlf") >= F.col("lf")
    lines = text.split_lines(F.col("t"))
    ended = F.slice(lines, F.lit(1), F.size(lines) - 1)
    odd = F.filter(F.transform(ended, lambda line, i: F.when(F.endswith(line, F.lit("\r")) != crlf_rules, (i + 1).cast("long"))), lambda i: i.isNotNull())
    mixed = (F.col("crlf") > 0) & (F.col("lf") > 0)
    style = F.when((F.col("crlf") == 0) & (F.col("lf") == 0), "none").when(F.col("lf") == 0, "crlf").when(F.col("crlf") == 0, "lf").otherwise("mixed")
    none = F.array().cast("array<bigint>")
    return counted.select("path", style.alias("style"), "crlf", "lf", (F.col("crlf") + F.col("lf") + 1).alias("total_lines"), F.when(mixed, odd).otherwise(none).alias("inconsistent_lines"))


def change_line_endings(files: DataFrame, style: str) -> DataFrame:
    """path, original_style, new_style, lines_changed, new_content, error. UTF-16 and UTF-32 files are refused, as the
    change is one of bytes; new_content is null where nothing changes."""
    style = style.lower()
    if style not in ("lf", "crlf"):
        raise ValueError("style must be lf or crlf")
    t = F.col("content").cast("string")
    original = text.line_ending_style(t)
    wide = F.coalesce(charset.bom_type(F.col("content")).isin("utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"), F.lit(False))
    rows = files.select("path", "content", original.alias("original_style"), wide.alias("wide"))
    keep = F.col("wide") | (F.col("original_style") == style) | (F.col("original_style") == "none")
    changed = text.crlf_count(t) if style == "lf" else text.lone_lf_count(t)
    return rows.select(
        "path",
        "original_style",
        F.when(keep, F.col("original_style")).otherwise(style).alias("new_style"),
        F.when(keep, F.lit(0)).otherwise(changed).cast("long").alias("lines_changed"),
        F.when(~keep, text.convert_line_endings(t, style).cast("binary")).alias("new_content"),
        F.when(F.col("wide"), "line ends of UTF-16 and UTF-32 files cannot be changed").alias("error"),
    )
