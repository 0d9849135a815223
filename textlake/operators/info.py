"""File metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions.policy import PathPolicy


def permissions(mode: Column) -> Column:
    return F.lpad(F.conv(mode.cast("string"), 10, 8), 3, "0")


def rfc3339(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssXXX")


def file_info(entries: DataFrame) -> DataFrame:
    """path, size, created, modified, accessed (text, to the second), is_directory, is_file, permissions."""
    return entries.select("path", "size", rfc3339(F.col("ctime")).alias("created"), rfc3339(F.col("mtime")).alias("modified"), rfc3339(F.col("atime")).alias("accessed"), F.col("is_dir").alias("is_directory"), "is_file", permissions(F.col("mode")).alias("permissions"))


def allowed_directories(spark: SparkSession, policy: PathPolicy) -> DataFrame:
    """directory, of every folder that may be touched."""
    return spark.createDataFrame([(d,) for d in policy.allowed], "directory string")
