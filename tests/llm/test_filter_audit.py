import re
from itertools import permutations

from cases import EDGES, sql_rows
from textlake.llm import filter_audit, queries

WORDS = re.compile("[^\\x20\\x09-\\x0D]+")


def plain(rows, labels):
    """Brute force: filter by filter, in every order. rows: (doc_id, text, lang)."""
    fails = []
    for i, t, _ in rows:
        t = t or ""
        w = WORDS.findall(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails.append({"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy})
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {x or "" for *_, x in rows}:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if fails[k][f]]
                redundant = [k for k in mine if k not in left and fails[k][f]]
                left = [k for k in left if not fails[k][f]]
                only = [k for k in mine if fails[k][f] and sum(fails[k].values()) == 1]
                out[part, "".join(order), step] = [len(left), len(gone), len(redundant), len(only), sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
        for f in "ABCDE":
            keys = [(part, "".join(o), o.index(f) + 1) for o in permutations("ABCDE")]
            total = sum(out[k][1] for k in keys)
            for k in keys:
                out[k].append(total)
    return out


def audited(spark, rows, labels):
    df = spark.createDataFrame([(i, t, x, 1, "c") for i, t, x in rows], "doc_id long, text string, lang string, mask int, digest string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.filter_audit(df, marks).collect()
    found = {(r.part, r.filter_order, r.step): list(r)[3:] for r in out}
    assert len(found) == len(out)
    return found


def test_audit_by_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(i, t, ("en", None, "fr")[k % 3]) for k, (i, t) in enumerate(EDGES)]
    rows += [(30, long, "en"), (31, long, "fr"), (31, long, "fr"), (29, long + " x #", "en"), (32, long.upper(), "en"), (33, long + "\x0b\x1c", "de"), (None, long, "en"), (34, long + " " + long, "en"), (35, "A" * 10 + "b" * 90, "de"), (36, "A" * 11 + "b" * 89, "de")]
    labels = [(31, 1, 0), (31, 0, 1), (29, 1, None), (4, None, 1), (None, 1, 1), (99, 1, 1), (36, 1, 0)]
    assert audited(spark, rows, labels) == plain(rows, labels)


def test_clean_part_and_empty_tables(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(100)), "xx")]
    found = audited(spark, rows, [(1, 1, 1)])
    assert len(found) == 600 and all(v == [1, 0, 0, 0, 0, 0, 0] for v in found.values())
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.filter_audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_query_against_sql(spark, sf):
    got = queries.op13_filter_audit(spark, sf).toPandas()
    want = sql_rows(sf, queries.FILTER_AUDIT_SQL)
    key = lambda d: sorted(map(tuple, d[sorted(d.columns)].values.tolist()))
    assert key(got) == key(want)
