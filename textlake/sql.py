"""The engine for spark.sql: functions and the entries source by name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textlake.functions import charset, glob, regex
from textlake.session import ship_package


def register(spark: SparkSession) -> None:
    """re2(pattern), glob_regex(pattern), search_regex(pattern): Java patterns for rlike; decode_text(bytes, name),
    encode_text(text, name), detect_charset(bytes); and the data source fs_entries."""
    from textlake.sources.fs_entries import FsEntries

    ship_package(spark)
    spark.dataSource.register(FsEntries)

    def scalar(f):
        @F.pandas_udf("string")
        def run(x: pd.Series) -> pd.Series:
            return x.map(lambda v: None if v is None else f(v))

        return run

    spark.udf.register("re2", scalar(regex.translate))
    spark.udf.register("glob_regex", scalar(glob.try_regex))
    spark.udf.register("search_regex", scalar(glob.search_regex))

    @F.pandas_udf("string")
    def decode_text(content: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or n is None else bytes(c).decode(charset.require(n).codec, "replace") for c, n in zip(content, name)], dtype="object")

    @F.pandas_udf("binary")
    def encode_text(text: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or n is None else t.encode(charset.require(n).codec) for t, n in zip(text, name)], dtype="object")

    @F.pandas_udf("string")
    def detect_charset(content: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else charset.detect_bytes(bytes(c))[0] for c in content], dtype="object")

    spark.udf.register("decode_text", decode_text)
    spark.udf.register("encode_text", encode_text)
    spark.udf.register("detect_charset", detect_charset)
