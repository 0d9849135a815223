import corpus_pipeline as cp
import numpy as np

from textlake.llm import langid


def test_short_clean_documents_stay_and_long_noise_goes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    short = [(10**6 + i, t, lang, "s", len(t)) for i, (t, lang) in enumerate([("A.", "en"), ("Avec.", "fr"), ("Edrere.", "en"), ("Lllldoado.", "es"), ("Re.", "en"), ("Erö.", "de"), ("Êai ierenê, pas é.", "fr")])]
    rng = np.random.default_rng(0)
    noise = "".join(map(chr, rng.integers(0x4E00, 0x9000, 3_000)))
    junk = [(2 * 10**6, noise, None, "s", len(noise)), (2 * 10**6 + 1, "12 34", "en", "s", 5), (2 * 10**6 + 2, None, "en", "s", 0)]
    kept = {r.doc_id for r in cp.language_id(spark, docs.union(spark.createDataFrame(short + junk, docs.schema)), sf).collect()}
    assert kept == {r.doc_id for r in docs.collect()} | {r[0] for r in short}


def test_variety():
    assert langid.variety("") == langid.variety("12") == 0
    assert langid.variety("abc") == 3 and langid.variety("se " * 500) < 5
