"""Which paths may be touched: a fixed set of allowed folders, checked before and after links are resolved."""

from __future__ import annotations

import os
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import Column
from pyspark.sql import functions as F


class PathError(ValueError):
    """code is INVALID_PATH, ACCESS_DENIED or SYMLINK_ESCAPE."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def expand_home(path: str) -> str:
    return os.path.expanduser(path) if path == "~" or path.startswith("~/") else path


def normalise(path: str) -> str:
    """Without quotes and white space around it, and without `.`, `..` and doubled separators."""
    path = path.strip(" \t\n\"'")
    return os.path.normpath(path) if path else ""


def root_uri_path(uri: str) -> str | None:
    """The path of a file:// URI."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme == "file" else None


@dataclass(frozen=True)
class PathPolicy:
    """Immutable; a new set of folders is a new policy."""

    allowed: tuple[str, ...] = ()

    @classmethod
    def of(cls, folders: list[str]) -> PathPolicy:
        """Folders may be missing, but not be files."""
        out = []
        for folder in folders:
            path = os.path.abspath(expand_home(normalise(folder)))
            if os.path.exists(path) and not os.path.isdir(path):
                raise PathError("INVALID_PATH", f"not a directory: {path}")
            for p in (path, os.path.realpath(path)):
                if p not in out:
                    out.append(p)
        return cls(tuple(out))

    def replaced(self, uris: list[str]) -> PathPolicy:
        """The policy for new roots; invalid ones are skipped, and with none left the old policy stays."""
        paths = []
        for uri in uris:
            path = root_uri_path(uri) if "://" in uri else uri
            if path and os.path.isdir(expand_home(path)):
                paths.append(path)
        return PathPolicy.of(paths) if paths else self

    def contains(self, path: str) -> bool:
        """Whether the path, as it is written, is an allowed folder or below one."""
        if not path or "\0" in path or not os.path.isabs(path):
            return False
        path = os.path.normpath(path)
        return any(path == d or path.startswith(d.rstrip("/") + "/") for d in self.allowed)

    def validate(self, path: str) -> str:
        """The real path. A missing file is judged by its folder; a missing folder by what is written."""
        path = normalise(path)
        if not path:
            raise PathError("INVALID_PATH", "path is required")
        if "\0" in path:
            raise PathError("INVALID_PATH", "path holds a NUL character")
        if not self.allowed:
            raise PathError("ACCESS_DENIED", "no allowed directories")
        full = os.path.abspath(expand_home(path))
        if not self.contains(full):
            raise PathError("ACCESS_DENIED", f"path is outside the allowed directories: {full}")
        if os.path.lexists(full):
            real = os.path.realpath(full)
            if not self.contains(real):
                raise PathError("SYMLINK_ESCAPE", f"link leads outside the allowed directories: {full}")
            return real
        parent = os.path.dirname(full)
        if os.path.lexists(parent):
            real = os.path.realpath(parent)
            if not self.contains(real):
                raise PathError("SYMLINK_ESCAPE", f"folder leads outside the allowed directories: {parent}")
            return os.path.join(real, os.path.basename(full))
        return full


def path_allowed(path: Column, folders: list[str]) -> Column:
    """The containment rule as a column expression, for clean absolute paths."""
    inside = F.lit(False)
    for d in folders:
        inside = inside | (path == d) | F.startswith(path, F.lit(d.rstrip("/") + "/"))
    return F.coalesce((path != "") & F.startswith(path, F.lit("/")) & (F.instr(path, "\0") == 0) & ~path.rlike(r"(^|/)\.\.?(/|$)|//") & inside, F.lit(False))
