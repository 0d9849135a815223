import re
from fnmatch import translate as fnmatch_translate

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlake.functions import glob


@pytest.mark.parametrize(
    "pattern,name,want",
    [("*.txt", "a.txt", True), ("*.txt", "a/b.txt", False), ("?", "é", True), ("?", "/", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("[^a]", "/", False), (r"\*", "*", True), (r"\*", "a", False), ("a.c", "abc", False), ("", "", True), ("a+(b)$", "a+(b)$", True), ("*", ".env", True), ("[]]", "]", None), ("[", "x", None), ("a\\", "a", None), ("[a-]", "a", None)],
)
def test_matches(pattern, name, want):
    if want is None:
        with pytest.raises(ValueError):
            glob.matches(pattern, name)
    else:
        assert glob.matches(pattern, name) is want


@given(st.text("ab.*?", max_size=6), st.text("ab.", max_size=6))
def test_like_fnmatch_without_separators(pattern, name):
    assert glob.matches(pattern, name) == (re.match(fnmatch_translate(pattern), name) is not None)


PATHS = ["root.txt", "subdir", "subdir/sub.txt", "subdir/deep/deep.txt", "src/a/handler/f.go", "src/f.go", "srcx/f.go", "node_modules/x/y.js", "a b.txt"]
SEARCHES = {
    "*.txt": ["root.txt", "subdir/sub.txt", "subdir/deep/deep.txt", "a b.txt"],
    "**/*.txt": ["root.txt", "subdir/sub.txt", "subdir/deep/deep.txt", "a b.txt"],
    "**": PATHS,
    "subdir/**": ["subdir", "subdir/sub.txt", "subdir/deep/deep.txt"],
    "subdir/*.txt": ["subdir/sub.txt"],
    "src/**/f.go": ["src/a/handler/f.go", "src/f.go"],
    "src/**/handler/*.go": ["src/a/handler/f.go"],
    "**/handler/f.go": ["src/a/handler/f.go"],
    "**/x/**": [],
    "[": [],
}


@pytest.mark.parametrize("pattern", SEARCHES)
def test_search(spark, pattern):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    assert [r.p for r in df.where(F.col("p").rlike(glob.search_regex(pattern))).collect()] == SEARCHES[pattern]
    assert [p for p in PATHS if re.search(glob.search_regex(pattern).replace(r"\z", r"\Z"), p)] == SEARCHES[pattern]


def test_exclusion_flavours(spark):
    df = spark.createDataFrame([(p, p.split("/")[-1]) for p in PATHS], "p string, n string")
    of = lambda c: [r.p for r in df.where(c).collect()]
    assert of(glob.excluded_from_tree(F.col("n"), ["subdir", "*.js"])) == ["subdir", "node_modules/x/y.js"]
    assert of(glob.excluded_from_json_tree(F.col("n"), ["sub"])) == ["subdir", "subdir/sub.txt"]
    assert of(glob.excluded_from_search(F.col("p"), ["node_modules", "**/deep.txt"])) == ["subdir/deep/deep.txt", "node_modules/x/y.js"]
    assert of(glob.pruned(F.col("p"), lambda p: glob.excluded_from_search(p, ["src"]))) == ["src/a/handler/f.go", "src/f.go"]
    assert of(glob.selected(F.col("p"), F.col("n"), ["*.txt"], ["root*"])) == ["subdir/sub.txt", "subdir/deep/deep.txt", "a b.txt"]
    assert of(glob.selected(F.col("p"), F.col("n"), ["["], None)) == []
