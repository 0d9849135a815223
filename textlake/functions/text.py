"""Scalar text and byte expressions; all of them are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LF, CRLF = "\n", "\r\n"


def split_lines(text: Column) -> Column:
    """Lines end at line feeds only; carriage returns stay, and a trailing line feed gives a last empty line."""
    return F.split(text, LF, -1)


def total_lines(text: Column) -> Column:
    return F.size(split_lines(text)).cast("long")


def crlf_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\r\n")).cast("long")


def lone_lf_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?<!\r)\n")).cast("long")


def line_ending_style(text: Column) -> Column:
    """none, crlf, lf or mixed; lone carriage returns do not count."""
    crlf, lf = crlf_count(text), lone_lf_count(text)
    return F.when((crlf == 0) & (lf == 0), "none").when(lf == 0, "crlf").when(crlf == 0, "lf").otherwise("mixed")


def to_lf(text: Column) -> Column:
    return F.replace(text, F.lit(CRLF), F.lit(LF))


def to_crlf(text: Column) -> Column:
    return F.replace(to_lf(text), F.lit(LF), F.lit(CRLF))


def convert_line_endings(text: Column, style: str) -> Column:
    """To crlf, or for any other style to lf."""
    return to_crlf(text) if style == "crlf" else to_lf(text)


def byte_column(line: Column, pattern: str) -> Column:
    """The first match's place in a line in UTF-8 bytes, from 1.

    regexp_instr counts UTF-16 units; the text before the match is cut in that encoding and measured in UTF-8.
    """
    units = F.regexp_instr(line, F.lit(pattern)) - 1
    before = F.decode(F.substring(F.encode(line, "UTF-16BE"), F.lit(1), 2 * units), "UTF-16BE")
    return (F.octet_length(before) + 1).cast("long")


def truncation_notice(limit: int, lines: Column, n_bytes: Column) -> Column:
    return F.format_string(f"\n\n[TRUNCATED at {limit} characters. File has %d lines, %d bytes. Use offset/limit for specific ranges.]", lines, n_bytes)


def leading_blank(line: Column) -> Column:
    """The spaces and tabs that a line begins with."""
    return F.regexp_extract(line, r"^([ \t]*)", 1)


def trim_space(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def version_numbers(version: Column) -> Column:
    """The first three numeric parts: a leading v and a -suffix are ignored, parts that are no numbers count as 0."""
    parts = F.split(F.split(F.regexp_replace(version, r"^v+", ""), "-").getItem(0), r"\.", -1)
    return F.array(*[F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0)) for i in range(3)])


def is_newer(latest: Column, current: Column) -> Column:
    return version_numbers(latest) > version_numbers(current)
