"""Session helpers: defaults for tests and benches, code shipping, shared scratch folders."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}
#: Whether Spark deletes the files of a query's shuffles at its end, instead of when the driver finds them to be garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: How many rows Spark hands to a Python worker at once.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: The most of them for whole texts: with more, JVM and worker hold several copies of what may be a task's whole input.
TEXT_ROWS = 1_000


def local_session(app: str = "textlake", cores: str = "*", **conf: str) -> SparkSession:
    """A session on this machine with the settings that the engine expects."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package.

    Workers that already find it through PYTHONPATH need nothing; for all others the sources are zipped once per
    application and distributed by Spark itself.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    if _ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="textlake-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "textlake_src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(os.path.join(_ROOT, "textlake")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a single machine a folder of our own where it
    is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="textlake-shared-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/textlake/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, hashes: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives the loss of executors. The shuffles of the
    write are deleted when it has ended.

    hashes: its values hardly repeat, so that dictionaries are not worth their making.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    kept = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out._textlake_path = path
    return out


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, what runs hands so many rows to a Python worker at once: for rows that are wide."""
    kept = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, kept)


def short_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """From now on, what runs hands so many rows to a Python worker at once, at most. Spark reads the setting when a query runs,
    which is after an operator has returned its plan; so it stays for the session."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= rows:
        spark.conf.set(BATCH_ROWS, str(rows))


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote."""
    for df in tables:
        path = getattr(df, "_textlake_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
