import pytest
from pyspark.sql import functions as F

from textlake.operators import grep, read
from textlake.operators.grep import GrepSpec


def found(files, **spec):
    return [tuple(r) for r in grep.grep(files, GrepSpec(**spec)).select("path", "line", "column", "text").collect()]


def test_context_is_clipped(files):
    f = files({"/a": b"MATCH 0\nline 2\nMATCH\nline 4"})
    rows = grep.grep(f, GrepSpec("MATCH", context_before=2, context_after=2)).collect()
    assert [(r.line, r.before, r.after) for r in rows] == [(1, [], ["line 2", "MATCH"]), (3, ["MATCH 0", "line 2"], ["line 4"])]


def test_bytes_columns(files):
    f = files({"/a": "aéfoo\nx😀é foo".encode()})
    assert found(f, pattern="foo") == [("/a", 1, 4, "aéfoo"), ("/a", 2, 9, "x😀é foo")]


def test_first_match_only_and_carriage_returns_stay(files):
    f = files({"/a": b"foo foo\r\nfoo"})
    assert found(f, pattern="foo") == [("/a", 1, 1, "foo foo\r"), ("/a", 2, 1, "foo")]
    assert found(f, pattern="foo$") == [("/a", 2, 1, "foo")]


def test_case_charset_and_binary(files):
    f = files({"/a": b"Hello World\nHELLO WORLD\nhello world", "/b": "Привет".encode("cp1251"), "/c": b"\0\1 hello", "/d": "hello".encode("utf-16"), "/e": None, "/f": b""})
    assert len(found(f, pattern="hello", case_sensitive=False)) == 3
    assert [r[:2] for r in found(f, pattern="Привет")] == [("/b", 1)]
    assert [r[0] for r in found(f, pattern="hello", scan_utf16=True)] == ["/a", "/d"]
    assert grep.summary(f, GrepSpec("hello")).first()["files_searched"] == 6


def test_unknown_encoding_is_taken_as_utf8(files):
    f = files({"/a": "é x".encode()})
    row = grep.grep(f, GrepSpec("x", encoding="nonsense")).first()
    assert (row.encoding, row.column) == ("utf-8", 4)
    assert grep.grep(files({"/b": "Тест".encode("koi8-r")}), GrepSpec("Тест", encoding="KOI8R")).count() == 1


@pytest.mark.parametrize("n,most,want,truncated", [(100, 10, 10, True), (10, 10, 10, False), (5, 0, 5, False)])
def test_cap(files, n, most, want, truncated):
    f = files({"/a": b"\n".join([b"hit"] * n)})
    assert len(found(f, pattern="hit", max_matches=most)) == want
    s = grep.summary(f, GrepSpec("hit", max_matches=most)).first()
    assert (s.total_matches, s.truncated, s.files_matched) == (want, truncated, 1)


def test_order_is_by_component(files):
    f = files({"/a-/z": b"x", "/a/b": b"x", "/a.txt": b"x"})
    assert [r[0] for r in found(f, pattern="x")] == ["/a/b", "/a-/z", "/a.txt"]


def test_nothing_to_search_and_bad_patterns(files):
    f = files({})
    assert grep.grep(f, GrepSpec("x")).count() == 0
    assert tuple(grep.summary(f, GrepSpec("x")).first()) == (0, 0, 0, False)
    for bad in ("", "(", "(?=x)"):
        with pytest.raises(ValueError):
            grep.grep(f, GrepSpec(bad))


def test_plan_has_no_exchange_before_the_limit(files):
    plan = grep.matches(files({"/a": b"x"}), GrepSpec("x", encoding="utf-8"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def lines(n):
    return "\n".join(f"line{i}" for i in range(1, n + 1)).encode()


@pytest.mark.parametrize(
    "data,options,want",
    [
        (lines(10), {"offset": 3, "limit": 4}, ("line3\nline4\nline5\nline6", 10, 3, 6, False)),
        (lines(5), {"offset": 3}, ("line3\nline4\nline5", 5, 3, 5, False)),
        (lines(5), {"limit": 2}, ("line1\nline2", 5, 1, 2, False)),
        (lines(5), {"offset": 9}, ("", 5, 6, 5, False)),
        (lines(5), {"offset": -1, "limit": 1}, ("line1", 5, 1, 1, False)),
        (b"short", {"max_characters": 1000}, ("short", 1, 1, 1, False)),
        (b"", {}, ("", 1, 1, 1, False)),
        (b"a\n", {}, ("a\n", 2, 1, 2, False)),
    ],
)
def test_read(files, data, options, want):
    r = read.read_text(files({"/a": data}), **options).first()
    assert (r.content, r.total_lines, r.start_line, r.end_line, r.truncated) == want


def test_cap_counts_code_points_after_the_slice(files):
    r = read.read_text(files({"/a": "Здравейте!".encode()}), max_characters=5).first()
    assert r.truncated and r.content == "Здрав\n\n[TRUNCATED at 5 characters. File has 1 lines, 19 bytes. Use offset/limit for specific ranges.]"
    r = read.read_text(files({"/a": b"\n".join([b"x" * 50] * 100)}), offset=10, limit=20, max_characters=100).first()
    assert r.truncated and r.total_lines == 100 and r.content.startswith("x" * 50 + "\n")


def test_labels(files):
    r = {x.path: x for x in read.read_text(files({"/a": b"abc", "/b": "Привет, мир".encode("cp1251"), "/c": b"\xff\xfe\0\0a\0\0\0"})).collect()}
    assert r["/a"].detected_encoding == "ascii" and r["/b"].content == "Привет, мир"
    assert r["/c"].detected_encoding == "utf-32-le (unsupported, using utf-8)"
    assert read.read_text(files({"/a": b"abc"}), encoding="utf8").first().detected_encoding is None
    with pytest.raises(ValueError):
        read.read_text(files({"/a": b"abc"}), encoding="nope")


def test_read_multiple(spark, files):
    f = files({"/ok/a": b"text", "/out/b": b"secret"})
    asked = spark.createDataFrame([(0, "/ok/a"), (1, "/ok/missing"), (2, "/out/b"), (3, "/ok/a"), (4, "")], "idx int, path string")
    out = read.read_multiple(asked, f, allowed=["/ok"])
    assert [(r.content, r.error_code) for r in out.orderBy("idx").collect()] == [("text", None), (None, "NOT_FOUND"), (None, "ACCESS_DENIED"), ("text", None), (None, "INVALID_PATH")]
    s = read.read_summary(out).first()
    assert (s.success_count, s.error_count, s.errors) == (2, 3, ["/ok/missing: file not found", "/out/b: access denied", ": path is required"])


def test_multi_root(files):
    a, b = files({"/a": b"x"}), files({"/a": b"x", "/b": b"x"})
    assert grep.union_of_roots(a, b).where(F.col("path") == "/a").count() == 1
