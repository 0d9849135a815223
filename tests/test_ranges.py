import io
import random

import pytest

from textlake.functions import charset
from textlake.operators import convert, grep
from textlake.operators.grep import GrepSpec
from textlake.sources import ranges
from textlake.sources.files import with_content


def lines_by_range(data, size, feed=b"\n", before=0, after=0):
    out = []
    for at in range(0, max(1, len(data)), size):
        found = ranges.RangeReader(io.BytesIO(data), len(data), feed).lines(at, min(size, len(data) - at), before, after)
        if found:
            out.append(found)
    return out


@pytest.mark.parametrize("step", [2, 64 << 10])
@pytest.mark.parametrize("wide", [False, True])
def test_ranges_tile_a_file(monkeypatch, step, wide):
    monkeypatch.setattr(ranges, "STEP", step)
    rnd, feed, codec = random.Random(7), (b"\n\0" if wide else b"\n"), ("utf-16-le" if wide else "utf-8")
    for _ in range(400):
        text = "".join(rnd.choice("ab\n\nਊé") for _ in range(rnd.randint(0, 30)))
        data, whole = text.encode(codec), text.split("\n")
        b, a = rnd.randint(0, 3), rnd.randint(0, 3)
        at = 0
        for x in lines_by_range(data, 2 * rnd.randint(1, 9), feed, b, a):
            got = x.content.decode(codec).split("\n")[: x.before + x.own + x.after]
            assert got[x.before : x.before + x.own] == whole[at : at + x.own]
            assert got[: x.before] == whole[max(0, at - b) : at] and got[x.before + x.own :] == whole[at + x.own : at + x.own + a]
            at += x.own
        assert at == len(whole), (text, step)


@pytest.fixture
def folder(tmp_path):
    rnd = random.Random(1)
    texts = {
        "a": "\n".join(rnd.choice(("hit me", "x" * 50, "", "a hit\r", "Hit é hit")) for _ in range(300)),
        "b": "no line feed at all, hit " + "y" * 500,
        "c": "",
        "d": "hit\n" * 40,
        "e": "\n\n\nhit",
    }
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    (tmp_path / "g").write_bytes("\n".join(["Ελλάδα και θάλασσα", "Καλημέρα κόσμε, hit"] * 30).encode("cp1253"))
    (tmp_path / "n").write_bytes(b"\0hit\n" * 10)
    (tmp_path / "w").write_bytes("\n".join(["hit one", "two é", "ਊ three"] * 30).encode("utf-16"))
    return tmp_path


def paths(spark, folder, more=()):
    rows = [(str(p), p.stat().st_size) for p in sorted(folder.iterdir())] + list(more)
    return spark.createDataFrame(rows, "path string, size long")


@pytest.mark.parametrize("size", [2, 10, 64, 1 << 20])
@pytest.mark.parametrize("spec", [GrepSpec("hit"), GrepSpec("^hit|é hit$", context_before=2, context_after=1), GrepSpec("HIT", case_sensitive=False, scan_utf16=True, context_after=2), GrepSpec("θάλασσα")])
def test_matches_by_ranges_are_those_of_whole_files(spark, folder, spec, size):
    files = paths(spark, folder)
    want = sorted(map(tuple, grep.matches(with_content(files.select("path")), spec).collect()))
    found = grep.grep_ranges(files.repartition(3), spec, size)
    assert sorted(map(tuple, found.collect())) == want and want
    assert found.columns == grep.matches(with_content(files.select("path")), spec).columns


def test_missing_files_and_bad_sizes(spark, folder):
    files = paths(spark, folder, [("/nowhere/x", 5), ("/nowhere/y", None)])
    assert grep.grep_ranges(files, GrepSpec("hit"), 64).count() == grep.grep_ranges(paths(spark, folder), GrepSpec("hit"), 64).count()
    errors = {r.path: r.error_code for r in ranges.with_bytes(ranges.ranges(files, 64)).where("error is not null").collect()}
    assert errors == {"/nowhere/x": "NOT_FOUND"}
    for size in (0, 3):
        with pytest.raises(ValueError):
            ranges.ranges(files, size)


def test_no_row_holds_a_file(spark, folder):
    rows = ranges.with_bytes(ranges.ranges(paths(spark, folder), 128)).collect()
    assert max(len(r.content) for r in rows) == 128 and sum(len(r.content) for r in rows) == sum(p.stat().st_size for p in folder.iterdir())
    lines = ranges.with_lines(ranges.ranges(paths(spark, folder), 128).where("path like '%/a'")).collect()
    assert max(len(r.content) for r in lines) < 128 + 51


def test_votes_over_ranges(spark, folder):
    votes = {r.path[-1]: r.charset for r in charset.vote(convert.range_votes(paths(spark, folder), 256)).collect()}
    assert votes["a"] == "utf-8" or votes["a"] == "ascii"
    assert votes["g"] == "windows-1253" and votes["b"] == "ascii"
