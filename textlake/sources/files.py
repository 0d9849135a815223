"""Contents of files by path, whole or in part. A file that cannot be read is a row with an error, not a failed job."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textlake.functions.charset import CHUNK
from textlake.session import ship_package


def error_code(e: Exception) -> str:
    if isinstance(e, FileNotFoundError):
        return "NOT_FOUND"
    if isinstance(e, PermissionError):
        return "PERMISSION"
    return "IO_ERROR"


def open_file(path: str) -> BinaryIO:
    """A file for reading with seek: a local path, or a URI of any file system that pyarrow knows."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def read_part(path: str, how: str, most: int) -> bytes:
    """whole, head (4 bytes, enough for a mark) or sample (first, middle and last CHUNK of large files)."""
    with open_file(path) as f:
        if how == "head":
            return f.read(4)
        f.seek(0, 2)
        size = f.tell()
        if how == "sample" and size > CHUNK:
            at = [0, *([(size - CHUNK) // 2] if size > 2 * CHUNK else []), size - CHUNK]
            out = []
            for a in at:
                f.seek(a)
                out.append(f.read(CHUNK))
            return b"".join(out)
        if size > most:
            raise OSError(f"file has {size} bytes, more than {most}")
        f.seek(0)
        return f.read()


def with_content(paths: DataFrame, how: str = "whole", most: int = 1 << 30, batch: int = 64 << 20) -> DataFrame:
    """paths (with a column path) plus content, error, error_code. Batches are cut at about `batch` bytes.

    Read whole, a file is one row and must fit into it; larger files go by ranges (see sources/ranges.py).
    """
    ship_package(paths.sparkSession)
    names = paths.columns
    at = names.index("path")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            start, size, content, errors, codes = 0, 0, [], [], []
            for i, path in enumerate(part.column(at).to_pylist()):
                data = error = code = None
                try:
                    data = read_part(path, how, most)
                except (OSError, TypeError, ValueError) as e:
                    error, code = f"{path}: {e}", error_code(e)
                content.append(data)
                errors.append(error)
                codes.append(code)
                size += len(data or b"")
                if size >= batch or i + 1 == part.num_rows:
                    own = part.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(content, pa.binary()), pa.array(errors, pa.string()), pa.array(codes, pa.string())], names=[*names, "content", "error", "error_code"])
                    start, size, content, errors, codes = i + 1, 0, [], [], []

    schema = StructType([*paths.schema.fields]).add("content", "binary").add("error", "string").add("error_code", "string")
    return paths.mapInArrow(run, schema)


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, length, content by Spark's own source: the way for large plain corpora in any file system it knows."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "content")


def corpus(spark: SparkSession, roots: list[str], most: int = 1 << 30, follow_outside: bool = False) -> DataFrame:
    """Files below the roots with contents, each real file once. Links that lead out of every root are skipped."""
    from textlake.functions.policy import PathPolicy, path_allowed
    from textlake.sources.fs_entries import fs_entries

    files = fs_entries(spark, roots).where("is_file")
    if not follow_outside:
        files = files.where(path_allowed(F.col("real_path"), list(PathPolicy.of(roots).allowed)) | ~F.col("is_symlink"))
    files = files.groupBy("real_path").agg(F.min("path").alias("path"), F.first("size").alias("size"), F.first("mode").alias("mode"))
    return with_content(files.select("path", "size", "mode"), most=most)
