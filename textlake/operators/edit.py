"""Text edits: ordered replacements of first occurrences, with a unified diff; files are only previewed here.

Edits apply one after the other to the file's text with LF line ends. The exact way is an expression; only rows for
which it fails go to Python, where an edit also matches lines that differ in white space at their ends. An edit without
a match is an error of the row, and nothing of that row is changed.
"""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import charset, text

#: Unicode white space, as text.trim_space() has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
EDITS = "array<struct<old_text:string,new_text:string>>"


def check_edits(edits: list[tuple[str, str]]) -> None:
    if not edits:
        raise ValueError("edits are required")
    if any(not old for old, _ in edits):
        raise ValueError("old text must not be empty")


def apply_exact(source: Column, edits: list[tuple[str, str]]) -> Column:
    """The text after all edits, or null if one of them does not occur as it is."""
    def step(old: str, new: str):
        def one(t: Column) -> Column:
            at = F.locate(old, t)
            return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.lit(new), F.substring(t, at + len(old), F.char_length(t))))

        return one

    out = source
    for old, new in edits:
        # Through an array, so that each step's text is computed once.
        out = F.element_at(F.transform(F.array(out), step(old.replace("\r\n", "\n"), new.replace("\r\n", "\n"))), 1)
    return out


def indent_of(line: str) -> str:
    return line[: len(line) - len(line.lstrip(" \t"))]


def reindent(new: str, old: str, found: list[str]) -> list[str]:
    """New lines on the found lines' indentation: the first takes it over, a later one moves by as many blanks as it is
    indented more or less than the old line in its place; lines beyond the old ones stay as they are."""
    old_lines, out = old.split("\n"), []
    base = indent_of(found[0])
    for i, line in enumerate(new.split("\n")):
        if i == 0:
            out.append(base + line.lstrip(" \t"))
        elif i < len(old_lines):
            shift = len(indent_of(line)) - len(indent_of(old_lines[i]))
            own = base + " " * shift if shift > 0 else base[: max(0, len(base) + shift)]
            out.append(own + line.lstrip(" \t"))
        else:
            out.append(line)
    return out


def apply_edits(source: str, edits: list[tuple[str, str]]) -> str:
    """Exact or flexible; ValueError names the text of an edit without a match."""
    for old, new in edits:
        old, new = old.replace("\r\n", "\n"), new.replace("\r\n", "\n")
        if old in source:
            source = source.replace(old, new, 1)
            continue
        lines, wanted = source.split("\n"), [x.strip(SPACE) for x in old.split("\n")]
        stripped = [x.strip(SPACE) for x in lines]
        at = next((i for i in range(len(lines) - len(wanted) + 1) if stripped[i : i + len(wanted)] == wanted), None)
        if at is None:
            raise ValueError(f"no match for edit: {old}")
        lines[at : at + len(wanted)] = reindent(new, old, lines[at : at + len(wanted)])
        source = "\n".join(lines)
    return source


def diff_lines(text: str) -> list[str]:
    """Lines with their ends; only a line feed ends a line."""
    return [x for x in re.split(r"(?<=\n)", text) if x]


def unified_diff(path: str, old: str, new: str) -> str:
    return "".join(x if x.endswith("\n") else x + "\n" for x in difflib.unified_diff(diff_lines(old), diff_lines(new), path, path, n=3))


def edit_files(files: DataFrame, edits: list[tuple[str, str]], encoding: str | None = None, force_writable: bool = False) -> DataFrame:
    """path, new_content, diff, error, error_code. A column mode refuses read-only files unless force_writable.

    Line ends are put back as they were; files with mixed ones get LF. new_content is what a sink would write.
    """
    check_edits(edits)
    kept = ["path", "content", *(["mode"] if "mode" in files.columns else [])]
    rows = charset.with_text(files.select(*kept), "edit", encoding).withColumnRenamed("text", "raw").withColumn("style", text.line_ending_style(F.col("raw")))
    rows = rows.withColumn("old", text.to_lf(F.col("raw"))).withColumn("exact", apply_exact(F.col("old"), edits))

    # Texts leave the batch one by one, so that a worker holds no second copy of all of them.
    @F.arrow_udf("struct<new:string,error:string>")
    def flexible(old: pa.Array) -> pa.Array:
        new, error = [], []
        for t in old:
            found = why = None
            if t.is_valid:
                try:
                    found = apply_edits(t.as_py(), edits)
                except ValueError as e:
                    why = str(e)
            new.append(found)
            error.append(why)
        return pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(error, pa.string())], names=["new", "error"])

    @F.arrow_udf("string")
    def diff(path: pa.Array, old: pa.Array, new: pa.Array) -> pa.Array:
        return pa.array((unified_diff(p.as_py(), o.as_py(), n.as_py()) if n.is_valid else None for p, o, n in zip(path, old, new)), pa.string())

    rows = rows.withColumn("flexible", flexible(F.when(F.col("exact").isNull(), F.col("old"))))
    read_only = F.lit(False)
    if "mode" in files.columns and not force_writable:
        read_only = (F.col("mode").bitwiseAND(128)) == 0
    rows = rows.withColumn("read_only", read_only)
    rows = rows.withColumn("new", F.when(~F.col("read_only"), F.coalesce("exact", "flexible.new")))
    restored = F.when(F.col("style") == "crlf", text.to_crlf(F.col("new"))).otherwise(F.col("new"))
    rows = rows.withColumn("bytes", charset.encode_text(restored, encoding or F.col("e.name")))
    error = F.when(F.col("read_only"), "file is read-only").otherwise(F.coalesce("flexible.error", "bytes.error"))
    code = F.when(F.col("read_only"), "PERMISSION").when(F.col("bytes.error").isNotNull(), "ENCODING").when(F.col("flexible.error").isNotNull(), "OPERATION_FAILED")
    ok = error.isNull()
    return rows.select("path", F.when(ok, F.col("bytes.content")).alias("new_content"), F.when(ok, diff("path", "old", "new")).alias("diff"), error.alias("error"), code.alias("error_code"))
