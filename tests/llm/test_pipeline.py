import corpus_pipeline as cp
from pyspark.sql import functions as F

from textlake import session
from textlake.llm import langid, secret_scan
from test_dedup import deduped
from test_near_copies import groups


def test_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", "en", "s", 5), (10**6 + 2, "", None, None, None)], docs.schema)
    docs = docs.union(junk)
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    kept = cp.language_id(spark, docs, sf)
    assert kept.columns == docs.columns
    model = langid.train_documents(docs)
    found = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    told = lambda r: r.score >= cp.LEAST_SCORE or langid.variety(r.text) < cp.LEAST_VARIETY
    want = sorted((i, r.text) for i, r in found.items() if r.lang_pred != "und" and told(r))
    assert rows(kept) == want and len(want) >= docs.count() - 6

    lines = cp.dedup_lines(spark, kept, sf)
    assert lines.columns == docs.columns
    expected = [(i, t) for (i, _), t in zip(want, deduped(want))]
    assert rows(lines) == expected
    assert lines.where(F.col("n_chars") != F.char_length("text")).count() == 0

    near = cp.simhash_dedup(spark, lines, sf)
    root = groups([t for _, t in expected])
    expected = [e for k, e in enumerate(expected) if root[k] == k]
    assert rows(near) == expected

    clean = cp.scan_secrets(spark, near, sf)
    expected = [(i, secret_scan.redact(t)) for i, t in expected]
    assert rows(clean) == expected and clean.columns == docs.columns

    packed = cp.pack(spark, clean, sf)
    pieces = {(r.doc_id, r.start): r for r in packed.collect()}
    assert {i for i, _ in pieces} == {i for i, _ in expected}
    assert sum(r.length for r in pieces.values()) == sum(r.doc_tokens for (_, s), r in pieces.items() if s == 0)


def test_empty_tables_and_repeated_rows(spark, sf):
    """Every stage takes an empty table; equal rows stay or go together, and their later lines count as copies."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, docs.where("doc_id < 0"), sf).count() == 0
    one = docs.orderBy("doc_id").limit(20)
    twice = one.union(one)
    for _, stage in cp.STAGES[:-1]:
        twice = stage(spark, twice, sf)
        assert twice.columns == docs.columns
    counts = twice.groupBy("doc_id", "text").count().collect()
    assert counts and all(r["count"] == 2 for r in counts)


def test_rows_without_an_id_and_clashing_columns(spark, sf):
    """Rows without an id stay, whatever they are copies of; columns beyond those of documents are left out, whatever their names."""
    text = "A clean document about the weather of the day, which is long enough to be told from others by its words. " * 3
    rows = [(1, text, "en", "s", len(text), 1, 2), (None, text, "en", "s", len(text), 3, 4), (None, text, "en", "s", len(text), 5, 6), (2, text, "en", "s", len(text), 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id long, lines_removed long")
    near = cp.simhash_dedup(spark, docs, sf)
    assert sorted((r.doc_id is not None, r.doc_id) for r in near.collect()) == [(False, None), (False, None), (True, 1)]
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == list(cp.COLUMNS)


def test_workers_hold_one_operators_caches():
    from textlake.llm import bpe, common, tokens

    tokens.LOADED["a", "b"], bpe._LOADED["a"] = 1, 2
    list(common.text_slices(iter(()), own=tokens.LOADED))
    assert tokens.LOADED and not bpe._LOADED
    list(common.text_slices(iter(())))
    assert not tokens.LOADED


def test_workers_get_texts_in_short_batches(spark, sf):
    """Also by plans that run after the stage has returned; a shorter setting of the user's stays."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(5)
    before = spark.conf.get(session.BATCH_ROWS)
    try:
        for _, stage in (s for s in cp.STAGES if s[0] in ("language_id", "secret_scan", "packing")):
            for rows, want in (("10000", str(session.TEXT_ROWS)), ("0", str(session.TEXT_ROWS)), ("7", "7")):
                spark.conf.set(session.BATCH_ROWS, rows)
                stage(spark, docs, sf)
                assert spark.conf.get(session.BATCH_ROWS) == want
    finally:
        spark.conf.set(session.BATCH_ROWS, before)


def test_memory_of_long_chunks_and_many_trigrams_is_bounded():
    import numpy as np
    from textlake.llm import tokens

    memo = tokens.Memo(lambda k: b"x" * len(k), 100_000)
    for i in range(5_000):
        assert memo[f"{i:06d}" * (40 if i % 2 else 10)]
    assert memo.size <= 101_000 and len(memo.old) * 200 < 200_000 and not any(len(k) > tokens.LONG for k in memo)
    rng = np.random.default_rng(0)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 2_000))) for _ in range(30)]
    grams, proto = langid.Grams(64), np.eye(1, 64)
    langid.classify(texts, grams, proto)
    assert grams.table.shape == (langid.MOST_GRAMS, 64) and len(grams.codes) <= langid.MOST_GRAMS and len(grams.letters) <= langid.MOST_LETTERS


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "secret_scan", "packing"] and cp.ORACLE_SQL is None
