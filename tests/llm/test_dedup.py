import hashlib
import math
import random

import pytest

from xxhash import xxh64_intdigest

from cases import EDGES, sql_rows
from textlake.llm import exact_dedup, line_dedup, queries


def xxhash(text):
    h = xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def plain_lines(rows, similarity=0.8):
    """Brute force: (index of row, line number) of removed lines, by the definition."""
    lines = []
    for k, (i, t) in enumerate(rows):
        for n, line in enumerate((t or "").split("\n")):
            words = [w for w in __import__("re").split(r"[\x09\x0B\x0C\x0D\x20]+", line.lower()) if w]
            if len(words) >= 5:
                lines.append(((-1 if i is None else i, xxhash(t), n), k, n, {tuple(words[j : j + 5]) for j in range(len(words) - 4)}))
    gone = set()
    for at, k, n, s in lines:
        if any(o < at and len(s & t) >= similarity * len(s | t) - 1e-9 for o, _, _, t in lines):
            gone.add((k, n))
    return gone


def deduped(rows, similarity=0.8):
    gone = plain_lines(rows, similarity)
    return [None if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if (k, n) not in gone) for k, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_lines_by_brute_force(docs, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["é", "Ab"]
    pool = [[rnd.choice(words) for _ in range(rnd.choice((3, 5, 9, 30, 60)))] for _ in range(25)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rnd.randint(0, 6)):
            line = list(rnd.choice(pool))
            for _ in range(rnd.choice((0, 0, 1, 2))):
                line[rnd.randrange(len(line))] = rnd.choice(words)
            text.append(rnd.choice((" ", "  ", "\t")).join(line))
        rows.append((i, "\n".join(text)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(*rows)).collect()}
    assert got == {i: t for (i, _), t in zip(rows, deduped(rows))}


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.9, 0.95, 0.99, 1.0])
def test_lines_by_brute_force_at_any_similarity(docs, similarity):
    """Long lines with a word more or less at an end, so that many pairs are just at the threshold."""
    rnd = random.Random(int(100 * similarity))
    rows, fresh = [], iter(range(10**6))
    for i in range(0, 60, 2):
        n = rnd.choice((20, 33, 50, 99, 100, 101, 150, 400))
        line = [f"w{next(fresh)}" for _ in range(n + 4)]
        less = max(0, round(n * (1 - similarity)) + rnd.choice((-1, 0, 0, 1)))
        rows += [(i, " ".join(line)), (i + 1, " ".join(line[: len(line) - less] if i % 4 else line + [f"w{next(fresh)}" for _ in range(less)]))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(*rows), similarity=similarity).collect()}
    assert got == {i: t for (i, _), t in zip(rows, deduped(rows, similarity))}


def test_lines_by_exchange_of_keys(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    rows = [(1, "one two three four five six seven\nx"), (2, "One two  three four five six seven\nz"), (3, " ".join(map(str, range(60)))), (4, " ".join(map(str, range(59))))]
    assert [r.text for r in line_dedup.dedup_lines(docs(*rows)).orderBy("doc_id").collect()] == deduped(rows)


def test_line_edges(docs):
    rows = [*EDGES, (5, "The cat sat on the mat. " * 40), (20, "one two three four five\nb"), (20, "x\none two three four five"), (20, "one two three four five\nb")]
    out = line_dedup.dedup_lines(docs(*rows))
    assert out.columns[-2:] == ["token", "lines_removed"]
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, ((i, t) for (i, _), t in zip(rows, deduped(rows)))))
    assert line_dedup.dedup_lines(docs()).count() == 0


def test_line_query_against_sql(spark, sf):
    got = queries.op2_line_dedup(spark, sf).toPandas()
    want = sql_rows(sf, queries.LINE_DEDUP_SQL)
    key = lambda d: sorted(map(tuple, d[sorted(d.columns)].values.tolist()))
    assert key(got) == key(want)


@pytest.mark.parametrize("fan_in", [2, 16])
@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact(docs, fan_in, keep):
    rows = [r for r in EDGES if r[1] != "repeated id" and r[0] is not None] + [(100 + i, "Same É" if i % 2 else "sAME É") for i in range(50)] + [(200, "same é")]
    norm = {i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for i, t in rows}
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(*rows, partitions=9), keep=keep, fan_in=fan_in).collect()}
    pick = max if keep == "max" else min
    for i, _ in rows:
        same = [j for j in norm if norm[j] == norm[i]]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (pick(same), len(same), i == pick(same))
        assert got[i].text_sha256 == hashlib.sha256(norm[i].encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs()).count() == 0


def test_rows_without_an_id(docs):
    rows = [(None, "a"), (None, "a"), (3, "b"), (None, "b"), (-(2**63), "c"), (1, "c"), (None, "d")]
    for keep in ("max", "min"):
        got = sorted(((r.text_sha256, r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(*rows), keep=keep).collect()), key=str)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        c = 1 if keep == "max" else -(2**63)
        want = [(sha("a"), None, None, 2, True)] * 2 + [(sha("b"), 3, 3, 2, True), (sha("b"), None, 3, 2, False), (sha("c"), 1, c, 2, c == 1), (sha("c"), -(2**63), c, 2, c != 1), (sha("d"), None, None, 1, True)]
        assert got == sorted(want, key=str)


def test_long_runs_are_cut_into_ranges(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RANGE_ROWS", 8)
    rows = [(i, f"text {i % 211}") for i in range(1500)]
    got = exact_dedup.exact_dedup(docs(*rows, partitions=6)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, max(range(i % 211, 1500, 211)), len(range(i % 211, 1500, 211))) for i in range(1500)}


def test_exact_query_against_sql(spark, sf):
    got = queries.op6_exact_dedup(spark, sf).toPandas()
    want = sql_rows(sf, queries.EXACT_DEDUP_SQL)
    key = lambda d: sorted(map(tuple, d[sorted(d.columns)].values.tolist()))
    assert key(got) == key(want)


def test_native_plans(docs, monkeypatch):
    plans, write = [], line_dedup.materialise
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(line_dedup, "materialise", lambda df, label, **kw: plans.append(text(df)) or write(df, label, **kw))
    rows = docs((1, "one two three four five six\nx"), (2, "one two three four five six"))
    plans += [text(line_dedup.dedup_lines(rows)), text(exact_dedup.exact_dedup(docs((1, "a"))))]
    assert len(plans) > 9
    for plan in plans:
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


@pytest.mark.parametrize("fan_in", [2, 3, 16])
def test_runs_of_each_level(spark, fan_in):
    """Runs are merged level by level, none is sorted anew behind an exchange; what is left is the merge of all."""
    rows = [(run, bytes([d]), 1, 7, 100 * run + d) for run in range(7) for d in range(run, 9) for _ in range(2)]
    runs = spark.createDataFrame(rows, "run int, digest binary, n_bytes int, check long, doc_id long")
    merged = exact_dedup.merge_runs(runs, 7, fan_in)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 + math.ceil(math.log(7) / math.log(fan_in) - 1e-9) and "Sort " not in plan and "SortAggregate" not in plan
    got = {bytes(r.digest)[0]: (r.keep_id, r.group_size) for r in merged.collect()}
    assert got == {d: (100 * min(6, d) + d, 2 * min(7, d + 1)) for d in range(9)}


def test_clashing_columns_and_a_document_of_many_lines(spark):
    many = "\n".join(f"the line of number {i} is not like others" for i in range(100_000))
    rows = [(1, "one two three four five\na", 1, 2, 3, 4), (2, "b\nOne two  three four five", 5, 6, 7, 8), (3, many + "\none two three four five", 9, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone int, lines int, lines_removed int, row int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_gone", "lines", "row", "lines_removed"]
    got = sorted(map(tuple, out.collect()))
    assert got == [(1, "one two three four five\na", 1, 2, 4, 0), (2, "b", 5, 6, 8, 1), (3, many, 9, 0, 0, 1)]


def test_frequent_tokens_go_another_way_with_the_same_result(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "FREQUENT", 2)
    test_lines_by_brute_force(docs, 1)


def test_cost_of_cleaning_and_of_the_order_of_tokens(docs, monkeypatch):
    """A text is searched for odd space five times at most; tokens go to their counts once, and are ranked without lists."""
    plans, write = {}, line_dedup.materialise
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def kept(df, label, **kw):
        plans[label] = text(df)
        return write(df, label, **kw)

    monkeypatch.setattr(line_dedup, "materialise", kept)
    monkeypatch.setattr(line_dedup, "FREQUENT", 2)
    rows = docs(*[(i, "\n".join(f"{w} two three four five six seven" for w in "abcd"[: 1 + i % 4])) for i in range(9)])
    rows.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")  # the plan shows reuse
    try:
        line_dedup.removed_lines(rows)
    finally:
        rows.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    assert plans["line-keys"].count("Contains(") <= 5
    assert "collect_list" not in plans["line-postings"] and "ObjectHashAggregate" not in plans["line-postings"]
    assert plans["line-postings"].count("REPARTITION_BY_COL") <= 1 + plans["line-postings"].count("ReusedExchange")


def test_space_around_lines(docs):
    line = "one two three four five six"
    odd = [f" {line}", f"{line} ", f"\t{line}", f"{line}\r", f"\x0b {line}\x0c", line.replace(" ", "\t"), line.replace(" ", " \r"), f"  {line.upper()}  "]
    rows = [(0, f" x\n{line}\n "), *((i + 1, f"a\n{o}\nb") for i, o in enumerate(odd)), (20, f"{line} \n y"), (21, f" \n{line}"), (22, "one two three four \n\t five six seven")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(*rows)).collect()}
    assert got == {i: t for (i, _), t in zip(rows, deduped(rows))}
    assert got[3] == "a\nb" and got[20] == " y" and got[22] == rows[-1][1]
