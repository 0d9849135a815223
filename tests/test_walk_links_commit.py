import os
import random

import pytest

from textlake.operators import links, read, search
from textlake.sinks import commit
from textlake.sources import fs_entries


@pytest.fixture
def tree(tmp_path):
    rnd = random.Random(2)
    folders = [tmp_path / "r"]
    for k in range(60):
        folders.append(rnd.choice(folders[-20:]) / f"d{k}")
    for k, f in enumerate(folders):
        f.mkdir(parents=True, exist_ok=True)
        for j in range(k % 4):
            (f / f"f{j}.txt").write_text("x" * j)
    (folders[3] / "skip").mkdir()
    (folders[3] / "skip" / "inner").mkdir()
    (folders[5] / ".hidden").write_text("h")
    os.symlink(folders[0], folders[7] / "up")
    return tmp_path / "r"


@pytest.mark.parametrize("share", [1, 7, 1000])
def test_walk_is_the_source(spark, tree, share):
    skip = [r"(^|/)skip(/|\z)"]
    key = lambda df: sorted(map(str, df.drop("atime").collect()))
    assert key(fs_entries.walk(spark, [str(tree)], exclude_regex=skip, share=share)) == key(fs_entries.fs_entries(spark, [str(tree)], exclude_regex=skip))
    assert key(fs_entries.walk(spark, [str(tree)], max_depth=3, share=share)) == key(fs_entries.fs_entries(spark, [str(tree)], max_depth=3))


def test_a_deep_folder_goes_to_many_tasks_and_excluded_ones_are_not_opened(tree, monkeypatch):
    opened, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(str(p)) or scandir(p))
    todo, rounds, names = [(str(tree), "")], 0, set()
    while todo:
        rows = [x for folder in todo for x in fs_entries.list_folders([folder], 2, lambda rel: rel.endswith("skip"))]
        names |= {r[2] for r in rows if not r[-1]}
        todo = [(r[0], r[2]) for r in rows if r[-1]]
        rounds += 1
    assert rounds > 3 and len(opened) == len(set(opened)) == 61
    assert not any("skip" in p for p in opened) and not any("skip" in n for n in names)


def test_roots_must_be_folders(spark, tree):
    file = str(next(p for p in tree.rglob("*.txt")))
    for bad in (file, str(tree / "nowhere")):
        with pytest.raises(ValueError):
            search.search_folder(spark, bad, "*")
        with pytest.raises(ValueError):
            fs_entries.walk(spark, [bad])
    with pytest.raises(ValueError, match="pattern"):
        search.search_folder(spark, "/nowhere", "")
    assert search.search_folder(spark, str(tree), "f2.txt").count() > 1
    with pytest.raises(ValueError):
        read.read_paths(spark, [])
    got = read.read_paths(spark, [file, "/nowhere/x", file]).orderBy("idx").collect()
    assert [r.error_code for r in got] == [None, "NOT_FOUND", None]


def test_links_by_brute_force(spark):
    rnd = random.Random(4)
    graph = {f"/a/{k}": rnd.choice((f"/a/{rnd.randrange(300)}", f"/a/{k + 1}", "/b/x", f"/a/{k}")) for k in range(200)} | {f"/a/c{k}": f"/a/c{k + 1}" for k in range(100)}

    def end(path):
        seen = []
        while path in graph:
            if path in seen:
                return None, None
            seen.append(path)
            path = graph[path]
        return path, len(seen)

    rows = [*graph.items(), ("/a/1", graph["/a/1"]), (None, "/a/1"), ("/a/n", None)]
    got = {r.path: r for r in links.resolve_links(spark.createDataFrame(rows, "path string, target string"), ["/a"]).collect()}
    assert {p: (r.real_path, r.hops) for p, r in got.items()} == {p: end(p) for p in graph}
    for p, r in got.items():
        assert r.error_code == ("IO_ERROR" if r.real_path is None else None if r.real_path.startswith("/a/") else "SYMLINK_ESCAPE"), p
    assert links.follow(spark.createDataFrame([], "path string, target string")).count() == 0


def contents(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir()}


def test_all_files_or_none(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"f{k}").write_bytes(b"old")
    os.chmod(tmp_path / "f3", 0o600)
    new = [(str(tmp_path / f"f{k}"), bytearray(b"new")) for k in range(20)] + [(str(tmp_path / "fresh"), bytearray(b"1")), (str(tmp_path / "f5x"), None)]
    rows = lambda more: spark.createDataFrame(new + more, "path string, new_content binary").repartition(4)
    before = contents(tmp_path)
    with pytest.raises(commit.SinkError) as e:
        commit.write_all(rows([(str(tmp_path / "missing" / "x"), bytearray(b"1"))]))
    assert len(e.value.failures) == 1 and contents(tmp_path) == before
    with pytest.raises(Exception):  # the task itself fails, and the job with it
        commit.write_all(rows([("bad\0name", bytearray(b"1"))]))
    assert contents(tmp_path) == before
    with pytest.raises(commit.SinkError):
        commit.write_all(rows([(str(tmp_path / "f1"), bytearray(b"other"))]))
    assert contents(tmp_path) == before
    out = commit.write_all(rows([]), backup=True)
    assert out.where("written").count() == 21
    want = {f"f{k}": b"new" for k in range(20)} | {f"f{k}.bak": b"old" for k in range(20)} | {"fresh": b"1"}
    assert contents(tmp_path) == want and os.stat(tmp_path / "f3").st_mode & 0o777 == 0o600


def test_a_commit_that_broke_off_is_carried_on(spark, tmp_path):
    job = "j" * 32
    for k in range(4):
        (tmp_path / f"f{k}").write_bytes(b"old")
        (tmp_path / f"f{k}.{job}.1.tmp").write_bytes(b"new")
    os.replace(tmp_path / f"f0.{job}.1.tmp", tmp_path / "f0")
    spark.createDataFrame([(str(tmp_path / f"f{k}"),) for k in range(4)], "path string").write.parquet(str(tmp_path / "list"))
    assert commit.resume(spark, str(tmp_path / "list"), job).where("written").count() == 4
    assert {k: v for k, v in ((p.name, p.read_bytes()) for p in tmp_path.iterdir() if p.is_file())} == {f"f{k}": b"new" for k in range(4)}
