"""The registered queries of this subpackage: thin views over its operators, at production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import ann, bpe, conversation_repair, exact_dedup, filter_audit, langid, licences, line_dedup, packing, secret_scan, simhash, token_counts, token_files
from textlake.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_docs(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_docs(spark, sf_dir))
    return out.select("doc_id", "lines_removed", F.octet_length("text").cast("long").alias("bytes_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=1)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digest(secret_scan.scan_secrets(_docs(spark, sf_dir)))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"), with_ids=False)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir), keep="max")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(_docs(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_rows(_docs(spark, sf_dir), scratch_path(spark, "token-files"), vocabulary("byte_bpe_50k.json"), end_id=0, n_ids=50_257)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_docs(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_digest(licences.scan_licences(_docs(spark, sf_dir)))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Query]:
    numbered = (
        op1_simhash, op2_line_dedup, op3_packing, op4_secrets, op5_bpe, op6_exact_dedup, op7_nearest, op8_language, op9_token_files, op10_token_counts,
        op11_licences, op12_conversations, op13_filter_audit,
    )
    return {f.__name__: f for f in numbered}


LINE_DEDUP_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs),
lines AS (
  SELECT doc_id, i - 1 AS line_no, ls[i] AS line,
         string_split(trim(regexp_replace(lower(ls[i]), '[\x09\x0B\x0C\x0D\x20]+', ' ', 'g'), ' '), ' ') AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
wordy AS (SELECT doc_id, line_no, w, array_to_string(w, ' ') AS norm FROM lines WHERE len(w) >= 5),
classes AS (SELECT norm, min((doc_id, line_no)) AS pos, any_value(w) AS w FROM wordy GROUP BY norm),
sets AS (SELECT row_number() OVER () AS id, norm, pos,
                list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
         FROM classes),
tokens AS (SELECT id, pos, len(s) AS n, unnest(s) AS token FROM sets),
shared AS (SELECT token FROM tokens GROUP BY token HAVING count(*) > 1),
t2 AS (SELECT t.* FROM tokens t JOIN shared USING (token)),
pairs AS (SELECT b.id, a.n AS na, b.n AS nb, count(*) AS c
          FROM t2 a JOIN t2 b ON a.token = b.token AND a.pos < b.pos GROUP BY a.id, b.id, a.n, b.n),
near AS (SELECT DISTINCT id FROM pairs WHERE c >= 0.8 * (na + nb - c) - 1e-9),
gone AS (SELECT l.doc_id, l.line_no FROM wordy l JOIN sets s ON l.norm = s.norm
         WHERE (l.doc_id, l.line_no) > s.pos OR s.id IN (SELECT id FROM near)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS text
         FROM lines l ANTI JOIN gone USING (doc_id, line_no) GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS lines_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.lines_removed, 0)::BIGINT AS lines_removed,
       strlen(coalesce(k.text, ''))::BIGINT AS bytes_kept, sha256(coalesce(k.text, '')) AS text_sha256
FROM docs d LEFT JOIN kept k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

EXACT_DEDUP_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


FILTER_AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
labelled AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         (len(w) < 100)::INT AS a, (100 * len(list_distinct(w)) < 80 * len(w))::INT AS b,
         (100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 10 * length(d.t))::INT AS c,
         regexp_matches(d.t, '[#$%&*|]')::INT AS x, coalesce(d.doc_id > firsts.first, false)::INT AS e
  FROM d JOIN firsts ON d.t = firsts.t LEFT JOIN labelled l ON d.doc_id = l.doc_id),
cells AS (SELECT part, a, b, c, x, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, a, b, c, x, e),
letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order
  FROM letters p JOIN letters q ON q.f <> p.f JOIN letters r ON r.f NOT IN (p.f, q.f)
  JOIN letters s ON s.f NOT IN (p.f, q.f, r.f) JOIN letters t ON t.f NOT IN (p.f, q.f, r.f, s.f)),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
fails AS (
  SELECT c.*, o.filter_order, o.step, o.filter_order[o.step] AS f,
         list_sum(list_transform(range(1, o.step), lambda i: CASE o.filter_order[i] WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c.c WHEN 'D' THEN x ELSE e END)) AS before,
         CASE o.filter_order[o.step] WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c.c WHEN 'D' THEN x ELSE e END AS now
  FROM cells c CROSS JOIN steps o),
counted AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN coalesce(before, 0) = 0 AND now = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN coalesce(before, 0) = 0 AND now = 1 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN coalesce(before, 0) > 0 AND now = 1 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN now = 1 AND a + b + c + x + e = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN coalesce(before, 0) = 0 AND now = 1 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN coalesce(before, 0) = 0 AND now = 1 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM fails GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP_SQL, "op6_exact_dedup": EXACT_DEDUP_SQL, "op13_filter_audit": FILTER_AUDIT_SQL}
