"""Directory trees as indented text and as JSON.

The order of a walk (a folder, then what is in it, names in byte order) is the order of path_key. The cap keeps the
first entries in that order with a distributed top-N; no window runs over all entries.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions import charset, glob
from textlake.session import materialise
from textlake.sources.files import with_content

DEFAULT_MOST = 1000


def visited(entries: DataFrame, exclude: list[str], max_depth: int = 0) -> DataFrame:
    """Entries that a walk meets, with `hidden` for those that are excluded; nothing below an excluded folder is met."""
    rows = entries
    if max_depth > 0:
        rows = rows.where(F.col("depth") < max_depth)
    names = F.col("path_key")
    if not exclude:
        return rows.withColumn("hidden", F.lit(False))
    above = F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0)))
    rows = rows.where(~F.exists(above, lambda n: glob.excluded_from_tree(n, exclude)))
    return rows.withColumn("hidden", glob.excluded_from_tree(F.col("name"), exclude))


def tree_entries(entries: DataFrame, max_depth: int = 0, max_files: int = DEFAULT_MOST, dirs_only: bool = False, exclude: list[str] | None = None) -> DataFrame:
    """path_key, depth, name, is_dir, line, path (where the entries have one) of the entries shown, in any order; line is the
    entry's line of text."""
    rows = visited(entries, exclude or [], max_depth)
    shown = rows.where(~F.col("hidden"))
    if dirs_only:
        shown = shown.where("is_dir")
    most = DEFAULT_MOST if max_files == 0 else max(0, max_files)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), "name", F.when(F.col("is_dir"), "/").otherwise(""))
    path = ["path"] if "path" in entries.columns else []
    return shown.orderBy("path_key").limit(most).select("path_key", "depth", "name", "is_dir", line.alias("line"), *path)


def encodings_of(shown: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """path_key, label of the files among the entries shown, from a sample of each; no other file is opened.

    contents (path, content) stands in for real files; what is shown, at most as many rows as the tree's cap, is looked up there.
    """
    files = shown.where(~F.col("is_dir")).select("path_key", "path")
    if contents is None:
        rows = with_content(files, "sample")
    else:
        rows = contents.select("path", "content").join(F.broadcast(files), "path")
    return rows.where("content is not null").select("path_key", charset.resolve(F.col("content"), "tree")["label"].alias("label"))


def tree(entries: DataFrame, max_depth: int = 0, max_files: int = DEFAULT_MOST, dirs_only: bool = False, exclude: list[str] | None = None, encodings: DataFrame | None = None, show_encoding: bool = False, contents: DataFrame | None = None) -> DataFrame:
    """One row: tree, file_count, dir_count, truncated.

    truncated is set when the cap is reached and the walk meets another entry, excluded ones and files of a dirs_only
    tree included. show_encoding adds a file's encoding to its line, found by encodings_of() for the entries shown only, or
    taken from encodings (path_key, label). The text has max_files lines at most.
    """
    shown = tree_entries(entries, max_depth, max_files, dirs_only, exclude)
    if show_encoding and encodings is None:
        shown = materialise(shown, "tree-shown")  # the cap comes first, and is not worked out again for the files
        encodings = encodings_of(shown, contents)
    if encodings is not None:
        shown = shown.join(encodings.select("path_key", "label"), "path_key", "left")
        shown = shown.withColumn("line", F.when(~F.col("is_dir") & F.col("label").isNotNull(), F.concat("line", F.lit("  ["), "label", F.lit("]"))).otherwise(F.col("line")))
    most = DEFAULT_MOST if max_files == 0 else max(0, max_files)
    listed = F.sort_array(F.collect_list(F.struct("path_key", "line")))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["line"], F.lit("\n"))), "")
    whole = shown.agg(text.alias("tree"), F.count_if(~F.col("is_dir")).alias("file_count"), F.count_if(F.col("is_dir")).alias("dir_count"), F.max("path_key").alias("last"), F.count("*").alias("n"))
    # A single row against all entries: is there one behind the last shown?
    behind = visited(entries, exclude or [], max_depth).join(F.broadcast(whole.select("last", "n")), F.expr(f"n >= {most} and (last is null or path_key > last)"), "left_semi")
    more = behind.limit(1).agg((F.count("*") > 0).alias("truncated"))
    return whole.join(F.broadcast(more), F.lit(True)).select("tree", "file_count", "dir_count", "truncated")


def json_tree_entries(entries: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """path_key, name, type (file or directory) of what the JSON tree shows."""
    rows = entries
    if exclude:
        rows = rows.where(~F.exists("path_key", lambda n: glob.excluded_from_json_tree(n, exclude)))
    return rows.select("path_key", "name", F.when(F.col("is_dir"), "directory").otherwise("file").alias("type"))


def directory_tree(entries: DataFrame, exclude: list[str] | None = None, most: int = 100_000) -> str:
    """The tree as indented JSON text, built on the driver; more than `most` entries are refused."""
    rows = json_tree_entries(entries, exclude).orderBy("path_key").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries")
    top: list[dict] = []
    children = {(): top}
    for r in rows:
        key = tuple(r["path_key"])
        node = {"name": r["name"], "type": r["type"]}
        if r["type"] == "directory":
            node["children"] = children[key] = []
        children[key[:-1]].append(node)
    return json.dumps(top, indent=2, ensure_ascii=False)
