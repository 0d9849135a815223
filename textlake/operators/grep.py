"""Regular expression search over files: scan, path filter, decode, line explode, filter, context, limit, aggregate.

The whole search is one plan without an exchange but for the final top-N. Lines are exploded only of files that are
selected, not binary and hold the literals that the pattern requires; context comes from the file's own lines around a
match, so it needs no window. Totals are aggregates over one row per file, or observed while matches are taken.

Files of any size are searched by ranges of bytes (grep_ranges): each range is searched as a file of its own, and line
numbers are its lines plus the prefix sum of those before it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textlake.functions import charset, glob, literals, regex, text
from textlake.session import materialise
from textlake.sources import files as sources
from textlake.sources import ranges

DEFAULT_MOST = 1000
PROBE = 8192


@dataclass(frozen=True)
class GrepSpec:
    pattern: str
    case_sensitive: bool = True
    context_before: int = 0
    context_after: int = 0
    max_matches: int = DEFAULT_MOST
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    encoding: str | None = None
    #: Bytes with a NUL count as binary, UTF-16 texts too; with this, files that begin with a UTF-16 mark are searched.
    scan_utf16: bool = False

    def compiled(self) -> str:
        if not self.pattern:
            raise ValueError("pattern is required")
        return regex.translate(self.pattern, not self.case_sensitive)

    @property
    def most(self) -> int:
        return self.max_matches if self.max_matches > 0 else DEFAULT_MOST


def is_binary(content: Column) -> Column:
    """A NUL among the first bytes."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, PROBE)) > 0


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def select_files(files: DataFrame, spec: GrepSpec) -> DataFrame:
    """The files that are searched; those that turn out to be binary or unreadable count as searched."""
    if not spec.include and not spec.exclude:
        return files
    return files.where(glob.selected(F.col("path"), name_of(F.col("path")), spec.include, spec.exclude))


def is_readable(spec: GrepSpec) -> Column:
    """Whether a file has content that is no binary data."""
    content = F.col("content")
    text_like = ~is_binary(content)
    if spec.scan_utf16:
        text_like = text_like | F.coalesce(charset.bom_type(content).isin("utf-16-le", "utf-16-be"), F.lit(False))
    return content.isNotNull() & text_like


def required(spec: GrepSpec) -> literals.Formula:
    return literals.required(spec.pattern, not spec.case_sensitive)


def decoded(files: DataFrame, spec: GrepSpec) -> DataFrame:
    """path, text, encoding of the files that can hold matches."""
    rows = files.where(is_readable(spec)).select("path", "content")
    rows = charset.with_text(rows, "grep", spec.encoding).select("path", "text", F.col("e.label").alias("encoding"))
    rows = rows.where("text <> ''")
    formula = required(spec)
    return rows if formula is None else rows.where(literals.may_match(F.col("text"), formula))


def matches(files: DataFrame, spec: GrepSpec) -> DataFrame:
    """path, line, column, text, before, after, encoding of every matching line; no limit, no order."""
    pattern = spec.compiled()
    rows = decoded(select_files(files, spec), spec)
    hit = lambda line: F.rlike(line, F.lit(pattern))
    column = text.byte_column(F.col("line_text"), pattern)
    if not spec.context_before and not spec.context_after:
        found = rows.select("path", "encoding", F.posexplode(text.split_lines(F.col("text"))).alias("i", "line_text")).where(hit(F.col("line_text")))
        empty = F.array().cast("array<string>")
        return found.select("path", (F.col("i") + 1).cast("long").alias("line"), column.alias("column"), F.col("line_text").alias("text"), empty.alias("before"), empty.alias("after"), "encoding")
    rows = rows.select("path", "encoding", text.split_lines(F.col("text")).alias("lines"))
    found = rows.select("path", "encoding", "lines", F.explode(places(F.col("lines"), pattern)).alias("i"))
    return at_places(found, spec)


def places(lines: Column, pattern: str) -> Column:
    """The numbers, from 1, of the lines that match."""
    return F.filter(F.transform(lines, lambda line, i: F.when(F.rlike(line, F.lit(pattern)), i + 1)), lambda i: i.isNotNull())


def at_places(found: DataFrame, spec: GrepSpec) -> DataFrame:
    """Matches of rows (path, encoding, lines, i), where i is the number of a line that matches."""
    i, b, a = F.col("i"), spec.context_before, spec.context_after
    before = F.slice("lines", F.greatest(F.lit(1), i - b), F.least(F.lit(b), i - 1))
    after = F.slice("lines", i + 1, F.lit(a))
    found = found.select("path", "encoding", "i", F.element_at("lines", i).alias("line_text"), before.alias("before"), after.alias("after"))
    column = text.byte_column(F.col("line_text"), spec.compiled())
    return found.select("path", i.cast("long").alias("line"), column.alias("column"), F.col("line_text").alias("text"), "before", "after", "encoding")


def grep(files: DataFrame, spec: GrepSpec) -> DataFrame:
    """The first max_matches matches by path (component by component) and line."""
    return matches(files, spec).orderBy(F.split("path", "/"), "line").limit(spec.most)


def per_file(files: DataFrame, spec: GrepSpec) -> DataFrame:
    """path, encoding, lines, at (the numbers of the lines that match) of every file that is searched; at is empty, and lines
    null, where a file is binary, unreadable, or cannot hold a match."""
    pattern, formula = spec.compiled(), required(spec)
    rows = select_files(files, spec).select("path", F.when(is_readable(spec), F.col("content")).alias("content"))
    rows = charset.with_text(rows, "grep", spec.encoding).select("path", "text", F.col("e.label").alias("encoding"))
    can = (F.col("text") != "") & literals.may_match(F.col("text"), formula)
    rows = rows.select("path", "encoding", F.when(can, text.split_lines(F.col("text"))).alias("lines"))
    return rows.select("*", F.coalesce(places(F.col("lines"), pattern), F.array().cast("array<int>")).alias("at"))


def _totals() -> list[Column]:
    n = F.size("at")
    return [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n"), F.count(F.lit(1)).alias("files_searched"), F.count(F.when(n > 0, 1)).alias("files_matched")]


def summary(files: DataFrame, spec: GrepSpec) -> DataFrame:
    """One row: total_matches (as returned), files_searched, files_matched (over all matches), truncated. One pass."""
    total = per_file(files, spec).agg(*_totals())
    return total.select(F.least("n", F.lit(spec.most)).cast("long").alias("total_matches"), "files_searched", "files_matched", (F.col("n") > spec.most).alias("truncated"))


@dataclass
class Search:
    """Matches, and the totals of the job that computes them."""

    matches: DataFrame
    observed: Observation
    most: int

    def totals(self) -> dict:
        """total_matches, files_searched, files_matched, truncated, as summary() has them; waits for a first action on matches."""
        x = self.observed.get
        return {"total_matches": min(x["n"], self.most), "files_searched": x["files_searched"], "files_matched": x["files_matched"], "truncated": x["n"] > self.most}


def search(files: DataFrame, spec: GrepSpec) -> Search:
    """The matches as grep() gives them, with totals observed in the same job."""
    seen = Observation()
    rows = per_file(files, spec).observe(seen, *_totals())
    found = at_places(rows.select("path", "encoding", "lines", F.explode("at").alias("i")), spec)
    return Search(found.orderBy(F.split("path", "/"), "line").limit(spec.most), seen, spec.most)


# Files of any size


def range_rows(files: DataFrame, spec: GrepSpec, size: int = ranges.RANGE) -> DataFrame:
    """The selected files (path, size) as ranges with their whole lines, plus label. The charset is that of a sample of the file."""
    heads = sources.with_content(select_files(files, spec).select("path", "size"), "sample")
    heads = heads.where(is_readable(spec)).select("path", "size", charset.resolve(F.col("content"), "grep", spec.encoding).alias("e"))
    heads = heads.select("path", "size", F.col("e.name").alias("charset"), F.col("e.label").alias("encoding"))
    return ranges.with_lines(ranges.ranges(heads, size), spec.context_before, spec.context_after)


def grep_ranges(files: DataFrame, spec: GrepSpec, size: int = ranges.RANGE) -> DataFrame:
    """What matches() finds, for files (path, size) of any size, read by ranges of bytes. No row holds more than the lines that
    begin in a range, with their context; each range is read once."""
    pattern, formula = spec.compiled(), required(spec)
    rows = range_rows(files, spec, size)
    whole = charset.decode_text(F.col("content"), F.col("charset"))
    rows = rows.select("path", "at", "encoding", "n_before", "n_lines", "n_after", whole.alias("text"))
    n = F.col("n_lines").cast("int")
    can = literals.may_match(F.col("text"), formula) & (F.col("text") != "")
    rows = rows.withColumn("lines", F.when(can, F.slice(text.split_lines(F.col("text")), F.lit(1), F.col("n_before") + n + F.col("n_after"))))
    mine = F.filter(places(F.col("lines"), pattern), lambda i: (i > F.col("n_before")) & (i <= F.col("n_before") + n))
    b, a = spec.context_before, spec.context_after
    # Only the lines that match, with their context, go on; not the range.
    hit = lambda i: F.struct(
        (i - F.col("n_before")).alias("i"),
        F.element_at("lines", i).alias("text"),
        F.slice("lines", F.greatest(F.lit(1), i - b), F.least(F.lit(b), i - 1)).alias("before") if b else F.array().cast("array<string>").alias("before"),
        F.slice("lines", i + 1, F.lit(a)).alias("after") if a else F.array().cast("array<string>").alias("after"),
    )
    rows = rows.select("path", "at", "encoding", "n_lines", F.coalesce(F.transform(mine, hit), F.array()).alias("hits"))
    found = materialise(rows, "grep-ranges")
    base = ranges.lines_before(found.select("path", "at", "n_lines"))
    out = found.where(F.size("hits") > 0).join(base, ["path", "at"]).select("path", "encoding", "base", F.explode("hits").alias("h"))
    column = text.byte_column(F.col("h.text"), pattern)
    return out.select("path", (F.col("base") + F.col("h.i")).alias("line"), column.alias("column"), F.col("h.text").alias("text"), F.col("h.before").alias("before"), F.col("h.after").alias("after"), "encoding")


def union_of_roots(*roots: DataFrame) -> DataFrame:
    """Each path once, however many roots hold it."""
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return out.dropDuplicates(["path"])
