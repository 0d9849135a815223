"""Glob patterns as regular expressions that Java and Python both read, and the three flavours of exclusion.

`*` and `?` never cross `/`; `[a-z]` and `[^a-z]` are classes; a backslash takes the next character as it is. With `**`
a pattern searches a tree:

* `**` matches everything;
* `**/S`: S matches the whole relative path, the last component or any run of last components;
* `P/**`: the path P itself and everything below it, P taken literally;
* `P/**/S`: below P, the rest matches as with `**/S`;
* more than one `**` matches nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = r"[^\s\S]"


def has_meta(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/ -]|(?<!^) )", lambda m: "\\" + m[1] if m[1].isascii() and m[1] not in " \n\t" else m[1], text)


def body(pattern: str) -> str:
    """The expression of a glob, without anchors. ValueError for a malformed pattern."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while pattern[i : i + 1] == "*":
                i += 1
            out.append("[^/]*")
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i >= len(pattern):
                raise ValueError(f"bad pattern: {pattern!r}")
            out.append(quote(pattern[i]))
        elif c == "[":
            text, i = _char_class(pattern, i)
            out.append(text)
            continue
        else:
            out.append(quote(c))
        i += 1
    return "".join(out)


def _char_class(pattern: str, i: int) -> tuple[str, int]:
    def one() -> str:
        nonlocal i
        if i >= len(pattern) or pattern[i] in "-]":
            raise ValueError(f"bad pattern: {pattern!r}")
        if pattern[i] == "\\":
            i += 1
            if i >= len(pattern):
                raise ValueError(f"bad pattern: {pattern!r}")
        i += 1
        return pattern[i - 1]

    i += 1
    negated = pattern[i : i + 1] == "^"
    i += negated
    ranges = []
    while not (pattern[i : i + 1] == "]" and ranges):
        low = one()
        high = low
        if pattern[i : i + 1] == "-":
            i += 1
            high = one()
        ranges.append((low, high))
    escape = lambda c: "\\" + c if c.isascii() and not c.isalnum() else c
    inner = "".join(f"{escape(a)}-{escape(b)}" for a, b in ranges if a <= b)
    if not inner:
        return ("[^/]" if negated else NOTHING), i + 1
    # A class never matches the separator.
    return (f"(?!/)[{'^' if negated else ''}{inner}]"), i + 1


def to_regex(pattern: str) -> str:
    return rf"(?s)\A(?:{body(pattern)})\z"


def matches(pattern: str, name: str) -> bool:
    return re.search(to_regex(pattern).replace(r"\z", r"\Z"), name) is not None


def try_regex(pattern: str) -> str:
    """to_regex, or an expression that matches nothing for a malformed pattern."""
    try:
        return to_regex(pattern)
    except ValueError:
        return NOTHING


def _suffix(pattern: str) -> str:
    return rf"(?:[^/]*/)*{body(pattern)}" if "/" not in pattern else rf"(?:(?:[^/]*/)*)?{body(pattern)}"


def search_regex(pattern: str) -> str:
    """An expression on the relative path for a search pattern."""
    try:
        if pattern.count("**") > 1:
            return NOTHING
        if "**" not in pattern:
            whole = body(pattern)
            return rf"(?s)\A(?:{whole})\z" if "/" in pattern else rf"(?s)\A(?:.*/)?(?:{whole})\z"
        before, after = pattern.split("**")
        before, after = before.rstrip("/"), after.lstrip("/")
        if not before and not after:
            return r"(?s)\A.*\z"
        if not after:
            return rf"(?s)\A{quote(before)}(?:/.*)?\z"
        under = rf"{quote(before)}/" if before else ""
        return rf"(?s)\A{under}(?:{_suffix(after)})\z"
    except ValueError:
        return NOTHING


def any_match(column: Column, patterns: list[str], regex=try_regex) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | column.rlike(regex(p))
    return found


def selected(path: Column, name: Column, include: list[str] | None, exclude: list[str] | None) -> Column:
    """Exclusion goes first; each pattern is tried on the name and on the whole path; no include takes everything."""
    out = ~(any_match(name, exclude or []) | any_match(path, exclude or []))
    if include:
        out = out & (any_match(name, include) | any_match(path, include))
    return out


def excluded_from_tree(name: Column, patterns: list[str]) -> Column:
    """The exact name or a glob on it."""
    return F.coalesce(name.isin(*patterns), F.lit(False)) | any_match(name, patterns) if patterns else F.lit(False)


def excluded_from_json_tree(name: Column, patterns: list[str]) -> Column:
    """The exact name, a glob on it, or for patterns without wildcards a part of it."""
    out = excluded_from_tree(name, patterns)
    for p in patterns:
        if not has_meta(p):
            out = out | F.contains(name, F.lit(p))
    return out


def excluded_from_search(rel_path: Column, patterns: list[str]) -> Column:
    """A search pattern on the relative path (without `/` also on the name), or for patterns without wildcards one of its components."""
    out = F.lit(False)
    for p in patterns:
        out = out | rel_path.rlike(search_regex(p))
        if not has_meta(p):
            out = out | F.array_contains(F.split(rel_path, "/"), F.lit(p))
    return out


def pruned(rel_path: Column, excluded) -> Column:
    """Whether a path or one of the folders above it is excluded; excluded takes a column of relative paths."""
    parts = F.split(rel_path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.exists(prefixes, excluded)
