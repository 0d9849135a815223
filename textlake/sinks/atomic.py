"""Writes in place: a temporary sibling, then a rename. Safe to run again, as each row's result depends on it alone.

Inputs of a write usually are the files themselves, so the rows must be materialised (written to the shared folder)
before; write_files() does so. Originals are backed up in a job of their own, before the first file changes, so that a
task that runs again never backs up converted bytes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.session import materialise, ship_package
from textlake.sources.files import error_code

NEW_FILE = 0o644
SCHEMA = "path string, written boolean, error string, error_code string"


def write_atomic(path: str, data: bytes) -> None:
    """Keep the mode of an existing file."""
    try:
        mode = os.stat(path).st_mode & 0o7777
    except FileNotFoundError:
        mode = NEW_FILE
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(temporary, "wb") as f:
            f.write(data)
        os.chmod(temporary, mode)
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def carry_out(rows: DataFrame, act) -> DataFrame:
    """act(row) for every row, with what came of it; an OSError is the row's, others are the job's."""
    ship_package(rows.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for row in part.to_pylist():
                try:
                    out.append((row["path"], act(row), None, None))
                except OSError as e:
                    out.append((row["path"], False, f"{row['path']}: {e}", error_code(e)))
            if out:
                path, written, error, code = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(written, pa.bool_()), pa.array(error, pa.string()), pa.array(code, pa.string())], names=["path", "written", "error", "error_code"])

    return rows.mapInArrow(run, SCHEMA)


def write_files(rows: DataFrame, backup: bool = False) -> DataFrame:
    """Write new_content (null: leave the file) to path; gives path, written, error, error_code, already carried out.

    With backup the original goes to path.bak first.
    """
    rows = materialise(rows.where(F.col("new_content").isNotNull()).select("path", "new_content"), "sink")
    if backup:

        def keep(row: dict) -> bool:
            if os.path.exists(row["path"]):
                with open(row["path"], "rb") as f:
                    write_atomic(row["path"] + ".bak", f.read())
            return True

        kept = materialise(carry_out(rows.select("path"), keep), "sink-backup")
        rows = rows.join(kept.where("written").select("path"), "path", "left_semi")

    def write(row: dict) -> bool:
        write_atomic(row["path"], row["new_content"])
        return True

    return materialise(carry_out(rows, write), "sink-result")
