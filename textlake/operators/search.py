"""Listing and searching entries by glob."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions import glob

DEFAULT_MOST = 10_000


def list_directory(entries: DataFrame, pattern: str = "*") -> DataFrame:
    """name, is_dir, label of the entries on the first level that the pattern matches, by name; label marks folders."""
    shown = entries.where((F.col("depth") == 0) & F.col("name").rlike(glob.to_regex(pattern)))
    label = F.when(F.col("is_dir"), F.concat(F.lit("[DIR] "), "name")).otherwise(F.col("name"))
    return shown.select("name", "is_dir", label.alias("label")).orderBy("name")


def found_entries(entries: DataFrame, pattern: str, exclude: list[str] | None = None) -> DataFrame:
    """Files and folders that match on their relative path and are not excluded, nor below an excluded folder."""
    if not pattern:
        raise ValueError("pattern is required")
    rows = entries
    if exclude:
        rows = rows.where(~glob.pruned(F.col("rel_path"), lambda p: glob.excluded_from_search(p, exclude)))
    return rows.where(F.col("rel_path").rlike(glob.search_regex(pattern)))


def search_files(entries: DataFrame, pattern: str, exclude: list[str] | None = None, max_results: int = DEFAULT_MOST) -> DataFrame:
    """path and is_dir of the first max_results entries, component by component."""
    most = max_results if max_results > 0 else DEFAULT_MOST
    return found_entries(entries, pattern, exclude).orderBy("path_key").limit(most).select("path", "is_dir")


def search_folder(spark: SparkSession, root: str, pattern: str, exclude: list[str] | None = None, max_results: int = DEFAULT_MOST) -> DataFrame:
    """search_files() below a real folder. A missing pattern is refused first, then a root that is no folder."""
    from textlake.sources.fs_entries import folder_entries

    if not pattern:
        raise ValueError("pattern is required")
    return search_files(folder_entries(spark, root), pattern, exclude, max_results)


def search_summary(entries: DataFrame, pattern: str, exclude: list[str] | None = None, max_results: int = DEFAULT_MOST) -> DataFrame:
    """One row: n_files (as returned) and truncated, which is set when the cap is reached, more or not."""
    most = max_results if max_results > 0 else DEFAULT_MOST
    return found_entries(entries, pattern, exclude).agg(F.count("*").alias("n")).select(F.least("n", F.lit(most)).cast("long").alias("n_files"), (F.col("n") >= most).alias("truncated"))
