import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlake.functions import charset, text
from textlake.operators import bom, convert, edit, lines


@pytest.mark.parametrize(
    "data,style,crlf,lf,total,odd",
    [
        (b"line1\r\nline2\r\nline3", "crlf", 2, 0, 3, []),
        (b"line1\nline2\nline3", "lf", 0, 2, 3, []),
        (b"line1\r\nline2\nline3\r\nline4\r\n", "mixed", 3, 1, 5, [2]),
        (b"line1\nline2\r\nline3\nline4\n", "mixed", 1, 3, 5, [2]),
        (b"line1\r\nline2\n", "mixed", 1, 1, 3, [2]),
        (b"line1\rline2\nline3", "lf", 0, 1, 2, []),
        (b"single line", "none", 0, 0, 1, []),
        (b"", "none", 0, 0, 1, []),
    ],
)
def test_line_endings(files, data, style, crlf, lf, total, odd):
    r = lines.detect_line_endings(files({"/a": data})).first()
    assert (r.style, r.crlf, r.lf, r.total_lines, r.inconsistent_lines) == (style, crlf, lf, total, odd)


def test_change_line_endings(files):
    r = lines.change_line_endings(files({"/a": b"line1\r\nline2\nline3\r\n"}), "LF").first()
    assert (r.original_style, r.new_style, r.lines_changed, bytes(r.new_content)) == ("mixed", "lf", 2, b"line1\nline2\nline3\n")
    r = lines.change_line_endings(files({"/a": b"line1\r\nline2\n\xff"}), "crlf").first()
    assert (r.lines_changed, bytes(r.new_content)) == (1, b"line1\r\nline2\r\n\xff")
    r = lines.change_line_endings(files({"/a": b"\xff\xfea\0\n\0"}), "crlf").first()
    assert r.error and r.new_content is None
    assert lines.change_line_endings(files({"/a": b"x"}), "crlf").first().new_style == "none"
    with pytest.raises(ValueError):
        lines.change_line_endings(files({}), "cr")


def test_boms(files):
    for name, mark in charset.BOMS:
        f = files({"/a": mark + b"payload!"})
        r = bom.manage_bom(f, "detect").first()
        assert (r.has_bom, r.bom_type, r.bom_bytes) == (True, name, len(mark))
        assert bytes(bom.manage_bom(f, "strip").first().new_content) == b"payload!"
        assert bom.manage_bom(f, "add", "utf-8").first().error
        added = bom.manage_bom(files({"/a": b"payload!"}), "add", name).first()
        assert bytes(added.new_content) == mark + b"payload!" and added.changed
    plain = files({"/a": b"x", "/e": b""})
    assert [(r.has_bom, r.changed) for r in bom.manage_bom(plain, "strip").collect()] == [(False, False)] * 2
    for bad in (("add", None), ("add", "nope"), ("add", "cp1251"), ("twist", None)):
        with pytest.raises(ValueError):
            bom.manage_bom(plain, *bad)


def test_registry(spark):
    rows = charset.encodings(spark).collect()
    assert len(rows) == 22 and [r.display_name for r in rows] == sorted(r.display_name for r in rows)
    assert charset.lookup("CP1251").name == "windows-1251" and charset.lookup("nope") is None
    assert charset.aliases(spark).count() == len(charset.BY_NAME)


SAMPLES = {"windows-1251": "Привет", "koi8-r": "Привет", "koi8-u": "Їжак", "ibm866": "Привет", "iso-8859-5": "Привет", "windows-1252": "naïve €", "iso-8859-1": "café", "iso-8859-15": "café €", "windows-1250": "Žluťoučký", "iso-8859-2": "Žluťoučký", "windows-1253": "Ελλάδα", "iso-8859-7": "Ελλάδα", "windows-1254": "İğne", "iso-8859-9": "İğne", "windows-1255": "שלום", "windows-1256": "سلام", "windows-1257": "Ąžuolas", "windows-1258": "Đông", "windows-874": "สวัสดี", "utf-8": "日本", "utf-16-le": "日本😀", "utf-16-be": "日本😀"}


def test_round_trip_of_every_encoding(spark):
    assert set(SAMPLES) == {e.name for e in charset.ENCODINGS}
    df = spark.createDataFrame(list(SAMPLES.items()), "name string, t string")
    df = df.withColumn("b", charset.encode_text(F.col("t"), F.col("name"))["content"])
    for r in df.withColumn("back", charset.decode_text(F.col("b"), F.col("name"))).collect():
        assert bytes(r.b) == r.t.encode(charset.BY_NAME[r.name].codec) and r.back == r.t
    for name, t in SAMPLES.items():
        own = spark.createDataFrame([(t,)], "t string").select(charset.encode_text(F.col("t"), name)["content"].alias("b"))
        assert own.select(charset.decode_text(F.col("b"), name)).first()[0] == t


def test_unrepresentable_text_is_an_error_of_the_row(spark):
    df = spark.createDataFrame([("Тест",), ("日本",)], "t string")
    got = [r[0] for r in df.select(charset.encode_text(F.col("t"), "cp1251")).collect()]
    assert bytes(got[0].content) == bytes([0xD2, 0xE5, 0xF1, 0xF2]) and got[1].content is None and "U+65E5" in got[1].error


@pytest.mark.parametrize("mode", ["full", "sample", "chunked"])
@pytest.mark.parametrize("n", [1, 300_000])
def test_detection(files, mode, n):
    cases = {"a": (b"Hello, World! " * n, "ascii"), "u": ("Grüße. ".encode() * n, "utf-8"), "c": ("Привет, как дела. ".encode("cp1251") * n, "windows-1251"), "k": ("Привет, как дела. ".encode("koi8-r") * n, "koi8-r"), "d": ("Привет, как дела. ".encode("cp866") * n, "ibm866"), "w": ("déjà vu, très bien. ".encode("cp1252") * n, "windows-1252"), "b": (b"\xef\xbb\xbfx", "utf-8"), "e": (b"", "utf-8")}
    out = {r.path: r for r in convert.detect_encoding(files({k: v[0] for k, v in cases.items()}), mode).collect()}
    assert {k: out[k].encoding for k in cases} == {k: v[1] for k, v in cases.items()}
    assert out["b"].has_bom and out["b"].confidence == 100


def test_chunks_are_rows(spark, files):
    f = files({"a": b"x" * (3 * charset.CHUNK + 5), "b": b""})
    assert [r["count"] for r in convert.chunk_votes(f).groupBy("path").count().orderBy("path").collect()] == [4, 1]
    votes = spark.createDataFrame([("p", "b", 60, 10), ("p", "a", 80, 10), ("q", "a", 50, 1), ("q", "b", 99, 2)], "path string, charset string, confidence int, weight long")
    assert [tuple(r) for r in charset.vote(votes).orderBy("path").collect()] == [("p", "a", 80), ("q", "b", 99)]


def test_policies(files):
    f = files({"/weak": b"\xe9" * 3, "/wide": b"\xff\xfe\0\0a\0\0\0", "/ok": "Привет, мир".encode("cp1251")})
    get = lambda p, **k: {r.path: r.e for r in f.select("path", charset.resolve(F.col("content"), p, **k).alias("e")).collect()}
    assert get("read")["/wide"].label == "utf-32-le (unsupported, using utf-8)" and get("read")["/ok"].name == "windows-1251"
    assert get("edit")["/wide"].name == "utf-8" and get("write")["/wide"].name == "windows-1251"
    assert get("convert")["/wide"].error and get("grep")["/wide"].name == "utf-8" and get("tree")["/wide"].label == "utf-32-le"
    assert get("grep", explicit="nope")["/ok"].name == "utf-8"
    with pytest.raises(ValueError):
        get("write", explicit="nope")


def test_convert(files):
    f = files({"/a": "Тест".encode()})
    r = convert.convert_encoding(f, "cp1251").first()
    assert (r.source, r.target, bytes(r.new_content), r.error_code) == ("utf-8", "windows-1251", "Тест".encode("cp1251"), None)
    r = convert.convert_encoding(f, "latin1", "UTF-8").first()
    assert r.new_content is None and r.error_code == "ENCODING"
    with pytest.raises(ValueError):
        convert.convert_encoding(f, "nope")


def test_encode_for_write_keeps_the_encoding(spark, files):
    new = spark.createDataFrame([("/a", "Тест"), ("/n", "Тест")], "path string, text string")
    out = {r.path: r for r in convert.encode_for_write(new, files({"/a": "Привет".encode()})).collect()}
    assert (out["/a"].encoding, out["/n"].encoding) == ("utf-8", "windows-1251")
    assert bytes(out["/n"].new_content) == "Тест".encode("cp1251")


def edited(files, data, *edits, **options):
    r = edit.edit_files(files({"/a": data}), list(edits), **options).first()
    return None if r.new_content is None else bytes(r.new_content), r.diff, r.error_code


def test_edits(files):
    assert edited(files, b"foo bar baz", ("foo", "FOO"), ("bar", "BAR"))[0] == b"FOO BAR baz"
    assert edited(files, b"aXbX", ("X", "Y"))[0] == b"aYbX"
    assert edited(files, b"line1\nline2\nline3", ("line1\nline2", "new1\nnew2"))[0] == b"new1\nnew2\nline3"
    assert edited(files, b"line1\r\nline2\r\nline3", ("line1\nline2", "new1\nnew2"))[0] == b"new1\r\nnew2\r\nline3"
    assert edited(files, b"a\r\nb\nc", ("c", "d"))[0] == b"a\nb\nd"
    assert edited(files, "Привет, мир".encode("cp1251"), ("мир", "дом"))[0] == "Привет, дом".encode("cp1251")
    assert edited(files, b"Hello World", ("Nonexistent", "x")) == (None, None, "OPERATION_FAILED")
    assert edited(files, b"abc", ("b", "日"), encoding="latin1")[2] == "ENCODING"
    assert edited(files, b"abc", ("c", ""), ("a", ""))[0] == b"b"
    for bad in ([], [("", "x")]):
        with pytest.raises(ValueError):
            edit.edit_files(files({}), bad)


def test_flexible_edits(files):
    assert edited(files, b"def f():\n    if x:  \n        y()\n", ("if x:\n    y()", "if z:\n    w()\n    v()"))[0] == b"def f():\n    if z:\n    w()\n    v()\n"
    assert edited(files, b"\ta\n\tb\n", ("a\n  b", "c\n    d"))[0] == b"\tc\n\t  d\n"
    assert edit.reindent("a\nb", "x\n    y", ["      x", "          y"]) == ["      a", "  b"]


def test_diff_and_read_only(files):
    new, diff, _ = edited(files, b"1\n2\n3\n4\n5\n6\n7\n8\n9\n", ("5", "five"))
    assert diff == "--- /a\n+++ /a\n@@ -2,7 +2,7 @@\n 2\n 3\n 4\n-5\n+five\n 6\n 7\n 8\n"
    f = files({"/a": b"x"}, mode={"/a": 0o444})
    assert edit.edit_files(f, [("x", "y")]).first().error_code == "PERMISSION"
    assert edit.edit_files(f, [("x", "y")], force_writable=True).first().error is None


@pytest.mark.parametrize("new,old,want", [("1.1.0-beta", "1.0.0", True), ("2", "1.0.0", True), ("1.0.0", "1.0.0", False), ("v1.0.1", "1.0.0", True), ("1.9.9", "1.10.0", False), ("x", "0.0.0", False), ("1.0.0.5", "1.0.0", False)])
def test_versions(spark, new, old, want):
    assert spark.range(1).select(text.is_newer(F.lit(new), F.lit(old))).first()[0] is want


@given(st.text("ab \n\r", max_size=12))
def test_python_edit_is_the_first_occurrence(t):
    if "a" in t:
        assert edit.apply_edits(t, [("a", "X")]) == t.replace("a", "X", 1)


def test_trim_space(spark):
    df = spark.createDataFrame([("\u00a0\t x y\u2003\n",)], "t string")
    assert df.select(text.trim_space(F.col("t"))).first()[0] == "x y"
    assert df.select(text.leading_blank(F.lit(" \tx"))).first()[0] == " \t"


def test_only_line_feeds_end_lines_of_a_diff():
    from textlake.operators.edit import unified_diff

    assert unified_diff("p", "x\fy\nq r\rs\n", "x\fz\nq r\rs\n").split("\n")[3:] == ["-x\fy", "+x\fz", " q r\rs", ""]


def test_sampled_detection_stops_early():
    from textlake.functions import charset

    russian = "Это обычный русский текст о погоде и природе. ".encode("cp1251")
    n = charset.CHUNK
    assert charset.detect_bytes(b"a" * n + russian * n, "sample") == ("ascii", 100, False)
    weak = (b"caf\xe9 " + b"a" * 40) * (n // 46 + 1)
    assert charset.guess(weak[:n])[1] < charset.HIGH
    assert charset.detect_bytes(weak[:n] + russian * (2 * n // len(russian) + 1), "sample")[0] == charset.guess(weak[:n] + (russian * (2 * n // len(russian) + 1))[-n:])[0]


@pytest.mark.parametrize(
    "name, written",
    [
        ("iso8859-7", "φα!! σμκλ!! σμκλ!! οτεν!! ι.!! " * 5),
        ("iso8859-7", "οηιο " * 1000 + "τνοη. "),
        ("cp1253", "ενση " * 300 + "μτρε αν.\n"),
        ("koi8-r", "овоомх " * 300 + "вопоте "),
    ],
)
def test_repeated_words_are_evidence_once(name, written):
    data = written.encode(name)
    found, _ = charset.guess(data)
    assert data.decode(charset.lookup(found).codec) == written
    assert charset.guess(data * 50)[0] == found


def test_words_are_remembered_over_pieces_and_only_so_many(monkeypatch):
    from textlake.functions import charset_guess

    monkeypatch.setattr(charset_guess, "PIECE", 6)
    assert charset_guess.different_words(b"\xe0\xe1 ab \xe0\xe1 \xe2") == b"\xe0\xe1 \xe2"
    monkeypatch.setattr(charset_guess, "WORDS", 0)
    assert charset_guess.different_words(b"\xe0\xe1 ab \xe0\xe1 \xe2").split() == [b"\xe0\xe1", b"\xe0\xe1", b"\xe2"]


def test_edits_go_row_by_row_without_pandas(files):
    data = {"/a": b"one\ntwo\n", "/b": b"  one \n\ttwo\n", "/c": b"three\n"}
    out = {r.path: r for r in edit.edit_files(files(data), [("one\ntwo", "ONE\n2")], "utf-8").collect()}
    assert bytes(out["/a"].new_content) == b"ONE\n2\n" and bytes(out["/b"].new_content).split() == [b"ONE", b"2"]
    assert out["/a"].diff.count("\n+") == 3 and out["/b"].error is None
    assert out["/c"].error_code == "OPERATION_FAILED" and out["/c"].new_content is None and out["/c"].diff is None
    assert not hasattr(edit, "pd")
