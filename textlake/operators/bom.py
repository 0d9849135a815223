"""Byte order marks: detect, strip, add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions import charset


def manage_bom(files: DataFrame, action: str, encoding: str | None = None) -> DataFrame:
    """path, has_bom, bom_type, bom_bytes, changed, new_content, error.

    strip leaves files without a mark as they are; add is an error for files that have one. An empty file has none.
    """
    content = F.col("content")
    found = charset.bom_type(content)
    rows = files.select("path", "content", found.alias("bom_type"), charset.bom_size(content).alias("bom_bytes"))
    has = F.col("bom_type").isNotNull()
    none = F.lit(None)
    if action == "detect":
        new, changed, error = none.cast("binary"), F.lit(False), none.cast("string")
    elif action == "strip":
        new, changed, error = F.when(has, charset.strip_bom(content)), has, none.cast("string")
    elif action == "add":
        if not encoding:
            raise ValueError("encoding is required")
        new, changed = charset.add_bom(content, encoding), ~has
        error = F.when(has, F.concat(F.lit("file already has a byte order mark: "), "bom_type"))
    else:
        raise ValueError(f"invalid action: {action}")
    return rows.select("path", has.alias("has_bom"), "bom_type", "bom_bytes", changed.alias("changed"), new.alias("new_content"), error.alias("error"))
