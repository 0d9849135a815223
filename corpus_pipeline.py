"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents. run()
writes every stage's table to the shared folder and reads it back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import langid, line_dedup, near_copies, packing, secret_scan
from textlake.llm.queries import vocabulary
from textlake.session import discard, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Cosines of unrelated vectors have a standard deviation of 1 / sqrt(DIM); a document is rejected below four of them.
LEAST_SCORE = 4 / langid.DIM**0.5
#: But the cosine of n independent trigrams with their own language grows like sqrt(n): of fewer than these it can be as low
#: in clean text (seen up to 30), so that such documents, which are too short to tell, stay.
LEAST_VARIETY = 64


def _as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters and those that no learned language resembles more than chance does, if they are
    long enough to tell."""
    model = langid.train_documents(docs)
    found = langid.predict(docs.select(*COLUMNS), model, variety_below=LEAST_SCORE)
    told = (F.col("score") >= LEAST_SCORE) | (F.col("variety") < LEAST_VARIETY)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & told).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that match an earlier one; documents stay, also those of which no line is left."""
    return _as_documents(line_dedup.dedup_lines(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more), keep the document with the smallest id. Rows that
    repeat an id stay or go together; rows without an id cannot be named, so they stay, whatever they are copies of."""
    groups = near_copies.near_copies(docs)
    gone = materialise(groups.where("doc_id <> component_id").select("doc_id"), "simhash-dropped")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    return _as_documents(secret_scan.redact_secrets(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2,048 tokens; a row per piece."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", simhash_dedup),
    ("secret_scan", scan_secrets),
    ("packing", pack),
]

#: The language model and the tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        new = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)  # what the stage before has written; the input is none of ours
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
