"""A Spark data source of directory entries: folders, empty ones too, hidden files, links, modes and times.

    spark.dataSource.register(FsEntries)
    spark.read.format("fs_entries").option("root", "/data").option("exclude", '["node_modules"]').load()

The driver lists the first level only; every folder on it is a partition, walked by a task. Excluded subtrees are never
walked. Folders reached by links are listed as links and not entered; unreadable ones are skipped.

walk() gives the same entries for trees that are too deep or uneven for that: in rounds over a frontier of folders, dealt anew
each time. A task lists `share` folders, those it finds included, and hands back the rest.
"""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "root string, path string, rel_path string, name string, depth int, path_key array<string>, is_dir boolean, is_file boolean, "
    "is_symlink boolean, real_path string, size bigint, mtime timestamp, atime timestamp, ctime timestamp, mode int"
)


class Walk(InputPartition):
    def __init__(self, root: str, rel: str, deep: bool):
        self.root, self.rel, self.deep = root, rel, deep


def _time(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"]) if "roots" in options else [options["root"]]
        self.max_depth = int(options.get("max_depth", "0"))
        self.exclude = [re.compile(p.replace(r"\z", r"\Z")) for p in json.loads(options.get("exclude_regex", "[]"))]

    def skipped(self, rel: str) -> bool:
        return any(p.search(rel) for p in self.exclude)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for root in self.roots:
            root = os.path.abspath(root)
            out.append(Walk(root, "", False))
            if self.max_depth == 1 or not os.path.isdir(root):
                continue
            with os.scandir(root) as it:
                out += [Walk(root, e.name, True) for e in it if e.is_dir(follow_symlinks=False) and not self.skipped(e.name)]
        return out

    def read(self, partition: Walk) -> Iterator[tuple]:
        root, todo = partition.root, [partition.rel]
        if not partition.rel and not os.path.isdir(root):
            if os.path.lexists(root):
                yield self.row(os.path.dirname(root), os.path.basename(root))
            return
        while todo:
            rel = todo.pop()
            try:
                with os.scandir(os.path.join(root, rel)) as it:
                    found = [(e.name, e.is_dir(follow_symlinks=False)) for e in it]
            except OSError:
                continue
            for name, is_dir in found:
                sub = f"{rel}/{name}" if rel else name
                if self.skipped(sub):
                    continue
                try:
                    yield self.row(root, sub)
                except OSError:
                    continue
                if is_dir and partition.deep and (not self.max_depth or sub.count("/") + 1 < self.max_depth):
                    todo.append(sub)

    @staticmethod
    def row(root: str, rel: str) -> tuple:
        path = os.path.join(root, rel)
        own = os.lstat(path)
        link = stat.S_ISLNK(own.st_mode)
        try:
            s = os.stat(path)
        except OSError:
            s = own
        is_dir = stat.S_ISDIR(own.st_mode)
        key = rel.split("/")
        return root, path, rel, key[-1], len(key) - 1, key, is_dir, not is_dir, link, os.path.realpath(path), s.st_size, _time(s.st_mtime), _time(s.st_atime), _time(s.st_ctime), stat.S_IMODE(s.st_mode)


class FsEntries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fs_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


_ARROW = pa.schema(
    [("root", pa.string()), ("path", pa.string()), ("rel_path", pa.string()), ("name", pa.string()), ("depth", pa.int32()), ("path_key", pa.list_(pa.string()))]
    + [(c, pa.bool_()) for c in ("is_dir", "is_file", "is_symlink")]
    + [("real_path", pa.string()), ("size", pa.int64())]
    + [(c, pa.timestamp("us", "UTC")) for c in ("mtime", "atime", "ctime")]
    + [("mode", pa.int32()), ("pending", pa.bool_())]
)


def list_folders(todo: list[tuple[str, str]], share: int, skipped: Callable[[str], bool], max_depth: int = 0) -> Iterator[tuple]:
    """Rows of the entries in folders (root, path below it) and in those found there, `share` folders in all; then a row with
    `pending` for each folder that is left. Folders that are skipped are neither listed nor opened."""
    todo, opened = list(reversed(todo)), 0
    while todo and opened < share:
        root, rel = todo.pop()
        opened += 1
        try:
            with os.scandir(os.path.join(root, rel)) as it:
                found = [(e.name, e.is_dir(follow_symlinks=False)) for e in it]
        except OSError:
            continue
        for name, is_dir in found:
            sub = f"{rel}/{name}" if rel else name
            if skipped(sub):
                continue
            try:
                yield (*Reader.row(root, sub), False)
            except OSError:
                continue
            if is_dir and (not max_depth or sub.count("/") + 1 < max_depth):
                todo.append((root, sub))
    for root, rel in todo:
        yield (root, None, rel, *[None] * 12, True)


def walk(spark: SparkSession, roots: list[str], max_depth: int = 0, exclude_regex: list[str] | None = None, share: int = 1_000) -> DataFrame:
    """The entries below the roots, which must be folders, in any order; as many rounds as it takes, each written to the shared
    folder. The driver sees whether anything is left, nothing else."""
    from textlake.session import materialise, ship_package

    ship_package(spark)
    for root in roots:
        if not os.path.isdir(root):
            raise ValueError(f"not a directory: {root}")
    patterns = [p.replace(r"\z", r"\Z") for p in exclude_regex or []]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(p) for p in patterns]
        todo = [x for part in parts for x in zip(part["root"].to_pylist(), part["rel_path"].to_pylist())]
        rows = list_folders(todo, share, lambda rel: any(p.search(rel) for p in compiled), max_depth)
        while held := list(islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), _ARROW)], schema=_ARROW)

    out = None
    frontier = spark.createDataFrame([(os.path.abspath(r), "") for r in roots], "root string, rel_path string")
    while True:
        found = materialise(frontier.repartition("root", "rel_path").mapInArrow(run, SCHEMA + ", pending boolean"), "walk")
        entries = found.where("not pending").drop("pending")
        out = entries if out is None else out.unionByName(entries)
        frontier = found.where("pending").select("root", "rel_path")
        if not frontier.limit(1).count():
            return out


def folder_entries(spark: SparkSession, root: str, max_depth: int = 0, exclude_regex: list[str] | None = None) -> DataFrame:
    """Entries below a root that must be a folder."""
    if not os.path.exists(root):
        raise ValueError(f"no such folder: {root}")
    if not os.path.isdir(root):
        raise ValueError(f"not a directory: {root}")
    return fs_entries(spark, [root], max_depth, exclude_regex)


def fs_entries(spark: SparkSession, roots: list[str], max_depth: int = 0, exclude_regex: list[str] | None = None) -> DataFrame:
    """Entries below the roots; a root that is a file is an entry itself. max_depth 1 lists one level."""
    from textlake.session import ship_package

    ship_package(spark)
    spark.dataSource.register(FsEntries)
    reader = spark.read.format("fs_entries").option("roots", json.dumps(roots)).option("max_depth", str(max_depth))
    return reader.option("exclude_regex", json.dumps(exclude_regex or [])).load()
