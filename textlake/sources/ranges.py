"""Files as ranges of bytes: rows of bounded size whatever the size of a file, read by seek, many tasks to a file.

A range stands for the lines that begin in it. Its border is the first line feed at or behind the last byte before
it, both at its front and at its end, so the ranges of a file tile it without a byte left out or read twice; only the task
that owns a line reads beyond its range, and none reads further than it must to know whether it owns one. Line numbers
are not known to a range: with the number of lines of each, they are prefix sums over the ranges before it.

In UTF-16 a line feed is two bytes at an even offset; range sizes are even.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textlake.session import ship_package
from textlake.sources.files import error_code, open_file

RANGE = 32 << 20
STEP = 64 << 10
#: Bytes of content in a record batch, about.
BATCH = 64 << 20


def ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """files (path, size, ...) with a row for each range, dealt over all tasks: plus at (its first byte) and length.

    An empty file has one empty range; files without a size (unreadable ones) have none.
    """
    if size < 2 or size % 2:
        raise ValueError("the size of ranges must be even")
    at = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size").cast("long") - 1, F.lit(0)), F.lit(size).cast("long"))
    rows = files.where("size is not null").select("*", F.explode(at).alias("at"))
    return rows.withColumn("length", F.least(F.lit(size).cast("long"), F.col("size").cast("long") - F.col("at"))).repartition("path", "at")


@dataclass(frozen=True)
class Lines:
    """Whole lines of a range, with lines of context before and behind them: the bytes, and how many lines of each there are.

    The file's last line has no line feed behind it, and may be empty; it belongs to the range of what stands before it.
    """

    content: bytes
    before: int
    own: int
    after: int


class RangeReader:
    def __init__(self, file: BinaryIO, size: int, feed: bytes = b"\n"):
        self.f, self.size, self.feed, self.width = file, size, feed, len(feed)

    def read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def behind_feed(self, at: int, end: int) -> int | None:
        """The place behind the first line feed that begins in [at, end), or None."""
        while at < end:
            data = self.read(at, min(STEP, end - at + self.width - 1))
            k = data.find(self.feed)
            while k >= 0 and (at + k) % self.width:
                k = data.find(self.feed, k + 1)
            if k >= 0:
                return at + k + self.width
            if len(data) < self.width:
                return None
            at += STEP
        return None

    def front(self, at: int, end: int) -> int | None:
        """Where the first line that begins in [at, end) begins."""
        if at == 0:
            return 0
        found = self.behind_feed(at - self.width, end - self.width)
        return found if found is not None and found < end else None

    def back(self, at: int, lines: int) -> int:
        """Where the lines-th line before the one that begins at `at` begins; 0 if there are not as many."""
        end, step = at - self.width, STEP  # what stands at `end` is the line feed of the line before
        while True:
            start = max(0, end - step)
            data, k, left = self.read(start, end - start), end - start, lines
            while left and (k := data.rfind(self.feed, 0, k)) >= 0:
                left -= (start + k) % self.width == 0
            if not left:
                return start + k + self.width
            if not start:
                return 0
            step *= 4

    def forth(self, at: int, lines: int) -> int:
        """Where the lines-th line from `at` on ends."""
        for _ in range(lines):
            found = self.behind_feed(at, self.size)
            if found is None:
                return self.size
            at = found
        return at

    def lines(self, at: int, length: int, before: int = 0, after: int = 0) -> Lines | None:
        """The lines that begin in [at, at + length), with context, or None if none does."""
        end = at + length
        if (start := self.front(at, end)) is None:
            return None
        stop = self.size if end >= self.size else (self.behind_feed(end - self.width, self.size) or self.size)
        last = stop == self.size
        a = self.back(start, before) if before and start else start
        b = self.forth(stop, after) if after and not last else stop
        data = self.read(a, b - a)
        behind = self.count(data[stop - a :])
        if behind < after and not last:  # the file's end came first
            behind += 1
        return Lines(data, self.count(data[: start - a]), self.count(data[start - a : stop - a]) + last, behind)

    def count(self, data: bytes) -> int:
        if self.width == 1:
            return data.count(self.feed)
        return sum(data[k : k + self.width] == self.feed for k in range(0, len(data), self.width))


def feed_of(charset: str | None) -> bytes:
    return {"utf-16-le": b"\n\0", "utf-16-be": b"\0\n"}.get(charset or "", b"\n")


def _with(rows: DataFrame, fields: list[tuple[str, str, pa.DataType]], read) -> DataFrame:
    """rows plus what read(file, row) gives for each (None: the row is left out), error and error_code."""
    ship_package(rows.sparkSession)
    names = rows.columns
    schema = StructType([*rows.schema.fields])
    for name, kind, _ in fields:
        schema = schema.add(name, kind)
    schema = schema.add("error", "string").add("error_code", "string")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            kept, found, size = [], [], 0
            for i, row in enumerate(part.to_pylist()):
                try:
                    with open_file(row["path"]) as f:
                        values = read(f, row)
                    own = None if values is None else (*values, None, None)
                except (OSError, TypeError, ValueError) as e:
                    own = (*[None] * len(fields), f"{row['path']}: {e}", error_code(e))
                if own is not None:
                    kept.append(i)
                    found.append(own)
                    size += len(own[0] or b"")
                if kept and (size >= BATCH or i + 1 == part.num_rows):
                    columns = [pa.array([x[k] for x in found], t) for k, t in enumerate([*(t for *_, t in fields), pa.string(), pa.string()])]
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(kept)).columns, *columns], names=[*names, *(n for n, *_ in fields), "error", "error_code"])
                    kept, found, size = [], [], 0

    return rows.mapInArrow(run, schema)


def with_bytes(rows: DataFrame) -> DataFrame:
    """Ranges plus content, their bytes as they are, error and error_code."""

    def read(f: BinaryIO, row: dict) -> tuple:
        f.seek(row["at"])
        return (f.read(row["length"]),)

    return _with(rows, [("content", "binary", pa.binary())], read)


def with_lines(rows: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Ranges plus content (the whole lines that begin in them, with lines of context around them), n_before, n_lines, n_after
    (how many lines there are before, of its own, and behind), error and error_code. Ranges in which no line begins are
    left out. A column charset, if there is one, tells how line feeds are written."""

    def read(f: BinaryIO, row: dict) -> tuple | None:
        found = RangeReader(f, row["size"], feed_of(row.get("charset"))).lines(row["at"], row["length"], before, after)
        return None if found is None else (found.content, found.before, found.own, found.after)

    fields = [("content", "binary", pa.binary()), ("n_before", "integer", pa.int32()), ("n_lines", "long", pa.int64()), ("n_after", "integer", pa.int32())]
    return _with(rows, fields, read)


def lines_before(counts: DataFrame, by: str = "path", order: str = "at", count: str = "n_lines") -> DataFrame:
    """path, at, base: the lines of the file's ranges before each. counts: path, at, n_lines, a row per range."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(by, order, F.coalesce(F.sum(count).over(before), F.lit(0).cast("long")).alias("base"))
