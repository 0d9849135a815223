import json
import os
import stat

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlake.config import EngineConfig
from textlake.functions.policy import PathError, PathPolicy, path_allowed
from textlake.operators import edit, grep, info, search, tree
from textlake.operators.grep import GrepSpec
from textlake.sinks import atomic, fsops
from textlake.sources.files import binary_files, corpus, with_content
from textlake.sources.fs_entries import fs_entries
from textlake.sources.virtual import entries_of_paths


@pytest.fixture
def folder(tmp_path):
    for name in ("src/handler/read.go", "src/server.go", "README.md", ".env", "node_modules/package.json", "a/b/c/deep.txt", "a-/z"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"findme in {name}\n" if name.endswith(".go") else "x\n")
    (tmp_path / "empty").mkdir()
    return tmp_path


def test_entries(spark, folder):
    os.symlink("/etc/hostname", folder / "out")
    rows = {r.rel_path: r for r in fs_entries(spark, [str(folder)]).collect()}
    assert {".env", "empty", "a/b/c/deep.txt", "out"} <= set(rows)
    assert rows["empty"].is_dir and rows["out"].is_symlink and rows["out"].is_file and rows["a/b/c"].depth == 2
    assert {r.name for r in fs_entries(spark, [str(folder)], max_depth=1).collect()} == set(os.listdir(folder))
    kept = {r.rel_path for r in fs_entries(spark, [str(folder)], exclude_regex=[r"(^|/)node_modules\z"]).collect()}
    assert not any(p.startswith("node_modules") for p in kept) and "a-/z" in kept


def test_list_and_search(spark, folder):
    e = fs_entries(spark, [str(folder)])
    assert [r.label for r in search.list_directory(e, "*a*").collect()] == ["[DIR] a", "[DIR] a-"]
    paths = lambda df: [os.path.relpath(r.path, folder) for r in df.collect()]
    assert paths(search.search_files(e, "**/*.go")) == ["src/handler/read.go", "src/server.go"]
    assert paths(search.search_files(e, "*.json", ["node_modules"])) == []
    assert len(paths(search.search_files(e, "**", max_results=3))) == 3
    s = search.search_summary(e, "*.go", max_results=2).first()
    assert (s.n_files, s.truncated) == (2, True)
    with pytest.raises(ValueError):
        search.search_files(e, "")


def virtual(spark, *paths):
    return entries_of_paths(spark.createDataFrame([(f"/r/{p}",) for p in paths], "path string"), "/r")


def test_tree(spark):
    e = virtual(spark, "src/handler/read.go", "src/server.go", "README.md")
    t = tree.tree(e).first()
    assert t.tree == "README.md\nsrc/\n  handler/\n    read.go\n  server.go\n" and (t.file_count, t.dir_count, t.truncated) == (3, 2, False)
    t = tree.tree(e, dirs_only=True).first()
    assert t.tree == "src/\n  handler/\n" and t.file_count == 0
    assert "deep" not in tree.tree(virtual(spark, "a/b/c/deep.txt"), max_depth=2).first().tree
    assert tree.tree(e, exclude=["src"]).first().tree == "README.md\n"
    labels = spark.createDataFrame([(["README.md"], "utf-8")], "path_key array<string>, label string")
    assert tree.tree(e, encodings=labels).first().tree.startswith("README.md  [utf-8]\n")


@pytest.mark.parametrize("most,n,truncated", [(5, 5, True), (20, 20, False), (19, 19, True), (0, 20, False), (-1, 0, True)])
def test_tree_cap(spark, most, n, truncated):
    t = tree.tree(virtual(spark, *[f"f{i:02}" for i in range(20)]), max_files=most).first()
    assert (t.file_count, t.truncated) == (n, truncated)


def test_tree_order_and_excluded_entries_behind_the_cap(spark):
    e = virtual(spark, "a/b", "a-/z", "a.txt")
    assert tree.tree(e).first().tree == "a/\n  b\na-/\n  z\na.txt\n"
    t = tree.tree(virtual(spark, "a", "b"), max_files=1, exclude=["b"]).first()
    assert t.tree == "a\n" and t.truncated
    assert tree.tree(virtual(spark)).first().truncated is False


def test_json_tree(spark):
    e = virtual(spark, "keep.txt", ".env", "node_modules/package.json", "d/x")
    assert json.loads(tree.directory_tree(e, [".env", "node_mod"])) == [{"name": "d", "type": "directory", "children": [{"name": "x", "type": "file"}]}, {"name": "keep.txt", "type": "file"}]
    with pytest.raises(ValueError):
        tree.directory_tree(e, most=2)


def test_contents_and_grep_on_files(spark, folder):
    os.symlink("/etc/hostname", folder / "out")
    (folder / "src/latin").write_bytes("Привет findme".encode("cp1251"))
    files = corpus(spark, [str(folder), str(folder / "src")])
    assert not [r for r in files.collect() if r.path.endswith("out")]
    found = grep.grep(files, GrepSpec("findme")).collect()
    assert [os.path.basename(r.path) for r in found] == ["read.go", "latin", "server.go"]
    assert grep.grep(files, GrepSpec("findme", include=["*.go"], exclude=["read*"])).count() == 1
    missing = with_content(spark.createDataFrame([(str(folder / "nope"),), (str(folder),)], "path string"))
    assert sorted(r.error_code for r in missing.collect()) == ["IO_ERROR", "NOT_FOUND"]
    big = with_content(spark.createDataFrame([(str(folder / "README.md"),)], "path string"), most=1).first()
    assert big.error_code == "IO_ERROR"
    assert bytes(with_content(spark.createDataFrame([(str(folder / "src/server.go"),)], "path string"), "head").first().content) == b"find"
    assert binary_files(spark, str(folder), "*.go").count() == 2


def test_file_info(spark, folder):
    os.chmod(folder / "README.md", 0o640)
    r = info.file_info(fs_entries(spark, [str(folder)])).where(F.col("path").endswith("README.md")).first()
    assert (r.size, r.is_file, r.is_directory, r.permissions) == (2, True, False, "640") and r.modified[10] == "T"


def test_sinks(spark, folder):
    p = folder / "crlf.txt"
    p.write_bytes(b"a\r\nb\r\n")
    os.chmod(p, 0o600)
    entries = fs_entries(spark, [str(folder)]).where("name = 'crlf.txt'")
    edits = edit.edit_files(with_content(entries.select("path", "mode")), [("a", "A")])
    assert p.read_bytes() == b"a\r\nb\r\n"
    out = atomic.write_files(edits, backup=True).collect()
    assert [r.written for r in out] == [True] and p.read_bytes() == b"A\r\nb\r\n"
    assert (folder / "crlf.txt.bak").read_bytes() == b"a\r\nb\r\n" and stat.S_IMODE(p.stat().st_mode) == 0o600
    new = spark.createDataFrame([(str(folder / "new"), bytearray(b"x")), (str(folder / "no/such/x"), bytearray(b"x")), (str(p), None)], "path string, new_content binary")
    codes = {os.path.basename(r.path): r.error_code for r in atomic.write_files(new).collect()}
    assert codes == {"new": None, "x": "NOT_FOUND"} and stat.S_IMODE((folder / "new").stat().st_mode) == 0o644
    assert not list(folder.glob("*.tmp"))


def test_commands(folder):
    policy = PathPolicy.of([str(folder)])
    at = lambda *p: str(folder.joinpath(*p))
    fsops.create_directory(policy, at("x/y"))
    fsops.copy_file(policy, at("README.md"), at("x/y/copy"))
    fsops.move_file(policy, at("x/y/copy"), at("x/moved"))
    fsops.delete_file(policy, at("x/moved"))
    for f, args, error in ((fsops.copy_file, (at("src"), at("z")), IsADirectoryError), (fsops.copy_file, (at("README.md"), at(".env")), FileExistsError), (fsops.move_file, (at("nope"), at("z")), FileNotFoundError), (fsops.move_file, (at("src"), at(".env")), FileExistsError), (fsops.delete_file, (at("src"),), IsADirectoryError), (fsops.delete_file, (at("nope"),), FileNotFoundError), (fsops.delete_file, ("/etc/passwd",), PathError)):
        with pytest.raises(error):
            f(policy, *args)


def test_policy(tmp_path):
    project = tmp_path / "project"
    project.mkdir()
    (tmp_path / "project2").mkdir()
    os.symlink(tmp_path / "project2", project / "link")
    policy = PathPolicy.of([str(project)])
    assert policy.validate(f'"{project}/new.txt" ') == os.path.realpath(project / "new.txt")
    for path, code in ((str(tmp_path / "project2/f"), "ACCESS_DENIED"), ("", "INVALID_PATH"), ("a\0b", "INVALID_PATH"), (str(project / "link/f"), "SYMLINK_ESCAPE"), (str(project / "../x"), "ACCESS_DENIED"), (str(project / "link"), "SYMLINK_ESCAPE")):
        with pytest.raises(PathError) as e:
            policy.validate(path)
        assert e.value.code == code
    with pytest.raises(PathError):
        PathPolicy().validate("/x")
    other = policy.replaced([f"file://{tmp_path}/project2", "http://x", "/nope"])
    assert other.contains(str(tmp_path / "project2/f")) and policy.replaced(["/nope"]) is policy


@given(st.text("/.pq2\0 ", max_size=14))
def test_what_is_accepted_is_contained(path):
    policy = PathPolicy(("/p/q",))
    if policy.contains(path):
        full = os.path.normpath(path)
        assert full == "/p/q" or full.startswith("/p/q/")


def test_path_column(spark):
    paths = ["/p/q", "/p/q/x", "/p/q2", "", "p/q", "/p/q/../x", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(path_allowed(F.col("p"), ["/p/q"])).collect()] == [True, True, False, False, False, False, False]


def test_config():
    assert EngineConfig.from_environment({}) == EngineConfig()
    c = EngineConfig.from_environment({"TEXTLAKE_DEFAULT_ENCODING": "UTF8", "TEXTLAKE_MEMORY_THRESHOLD": "5"})
    assert (c.default_encoding, c.memory_threshold) == ("utf-8", 5)
    assert EngineConfig.from_environment({"TEXTLAKE_DEFAULT_ENCODING": "x", "TEXTLAKE_MEMORY_THRESHOLD": "-1"}) == EngineConfig()
