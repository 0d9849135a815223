"""A set of files written as one: either all of them change, or none does and nothing is left behind.

1. Stage: every task writes its files' new contents to siblings that carry the job's name. The list of what has been staged
   is a table in the shared folder, of whatever length; the driver sees counts only.
2. If a file could not be staged, or the job failed, the siblings are removed, those of killed tasks too: they are found by
   the job's name beside every path that was asked for. No original has been touched.
3. Commit: originals are kept as backups if asked for, then siblings are renamed, from the list. Both can be done again
   without harm, so a commit that breaks off is carried on with resume().

Renames of single files are atomic; readers may see some of the new files before all of them are there.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.session import materialise
from textlake.sinks.atomic import NEW_FILE, carry_out


class SinkError(OSError):
    """Nothing was written; failures has path and error of some files that could not be staged."""

    def __init__(self, failures: list[tuple[str, str]]):
        super().__init__("; ".join(error for _, error in failures) or "the job failed")
        self.failures = failures


def staged_name(path: str, job: str) -> str:
    return f"{path}.{job}.{uuid.uuid4().hex}.tmp"


def staged_files(path: str, job: str) -> list[str]:
    return glob.glob(f"{glob.escape(path)}.{job}.*.tmp")


def _stage(job: str) -> Callable[[dict], bool]:
    def act(row: dict) -> bool:
        path = row["path"]
        try:
            mode = os.stat(path).st_mode & 0o7777
        except FileNotFoundError:
            mode = NEW_FILE
        for old in staged_files(path, job):  # of an attempt that was killed
            os.unlink(old)
        with open(staged_name(path, job), "wb") as f:
            f.write(row["new_content"])
            f.flush()
            os.fsync(f.fileno())
            os.fchmod(f.fileno(), mode)
        return True

    return act


def _unstage(job: str) -> Callable[[dict], bool]:
    def act(row: dict) -> bool:
        for name in staged_files(row["path"], job) if row["path"] and "\0" not in row["path"] else ():
            os.unlink(name)
        return True

    return act


def _commit(job: str, backup: bool) -> Callable[[dict], bool]:
    def act(row: dict) -> bool:
        path, found = row["path"], staged_files(row["path"], job)
        if not found:  # renamed by an attempt before this one
            return True
        if backup and os.path.exists(path):
            kept = f"{path}.{job}.bak.tmp"
            if os.path.exists(kept):
                os.unlink(kept)
            os.link(path, kept)
            os.replace(kept, path + ".bak")
        os.replace(found[0], path)
        for name in found[1:]:
            os.unlink(name)
        return True

    return act


def resume(spark: SparkSession, listed: str, job: str, backup: bool = False) -> DataFrame:
    """Carry on a commit from its list; gives path, written, error, error_code."""
    return materialise(carry_out(spark.read.parquet(listed).select("path"), _commit(job, backup)), "commit-result")


def write_all(rows: DataFrame, backup: bool = False) -> DataFrame:
    """Write new_content (null: leave the file) to path, all of them or none; gives path, written, error, error_code.

    Rows that repeat a path are refused. SinkError if anything could not be staged.
    """
    spark, job = rows.sparkSession, uuid.uuid4().hex
    rows = materialise(rows.where(F.col("new_content").isNotNull()).select("path", "new_content"), "commit-rows")
    twice = [r["path"] for r in rows.groupBy("path").count().where("count > 1").limit(10).collect()]
    if twice:
        raise SinkError([(p, f"{p}: more than one content") for p in twice])
    try:
        staged = materialise(carry_out(rows, _stage(job)), "commit-staged")
        failures = [(r["path"], r["error"]) for r in staged.where("not written").limit(10).collect()]
        if failures:
            raise SinkError(failures)
    except BaseException:
        materialise(carry_out(rows.select("path"), _unstage(job)), "commit-aborted")
        raise
    return resume(spark, staged._textlake_path, job, backup)
