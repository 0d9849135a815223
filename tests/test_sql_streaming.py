from textlake import sql
from textlake.operators.grep import GrepSpec
from textlake.streaming.grep_stream import arriving_files, counts_per_file, grep_stream


def test_sql_functions(spark, tmp_path):
    sql.register(spark)
    row = spark.sql(r"select 'aé' rlike re2('(?i)É') as a, 'x/y.txt' rlike search_regex('*.txt') as b, decode_text(X'CFF0E8E2E5F2', 'cp1251') as c, hex(encode_text('é', 'latin1')) as d, detect_charset(X'EFBBBF') as e, 'b.txt' rlike glob_regex('[a-c].*') as f").first()
    assert tuple(row) == (True, True, "Привет", "E9", "utf-8", True)
    (tmp_path / ".hidden").write_text("x")
    assert spark.read.format("fs_entries").option("root", str(tmp_path)).load().first()["name"] == ".hidden"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("foo\nbar\nfoo")
    found = grep_stream(arriving_files(spark, str(tmp_path / "in"), "*.txt"), GrepSpec("foo"))
    q = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    c = counts_per_file(found).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).start()
    try:
        q.processAllAvailable()
        (tmp_path / "in/b.txt").write_text("foo")
        q.processAllAvailable()
        c.processAllAvailable()
    finally:
        q.stop()
        c.stop()
    assert [tuple(r) for r in spark.sql("select line, column from found order by path, line").collect()] == [(1, 1), (3, 1), (1, 1)]
    assert sorted(r.n for r in spark.sql("select * from counts").collect()) == [1, 2]
