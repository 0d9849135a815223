"""The registered queries of the engine's operators, over virtual corpora, each with the SQL that gives the same rows.

Lists are joined and bytes written in hexadecimal, so that results of both engines compare value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions import charset, policy, text
from textlake.operators import bom, convert, edit, grep, info, lines, links, read, search, tree
from textlake.operators.grep import GrepSpec
from textlake.sources import virtual

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Virtual files and their lines in DuckDB; the same rules as in sources/virtual.py.
V = """v AS (SELECT doc_id, '/corpus/' || lang || '/' || source || '/doc_' || doc_id ||
  CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' ELSE '.pas' END AS path, text FROM documents)"""
L = """l AS (SELECT doc_id, path, ls, i AS line, ls[i] AS text FROM (
  SELECT doc_id, path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, path, string_split(text, chr(10)) AS ls FROM v WHERE text <> '')))"""
EOL = r"""e AS (SELECT doc_id, path, CASE doc_id % 4 WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10))
  WHEN 2 THEN replace(text, '.' || chr(10), '.' || chr(13) || chr(10)) WHEN 3 THEN replace(text, chr(10), '') ELSE text END AS text FROM v),
c AS (SELECT *, len(regexp_extract_all(text, '\r\n')) AS crlf, len(regexp_extract_all(text, '\n')) - len(regexp_extract_all(text, '\r\n')) AS lf FROM e),
s AS (SELECT *, CASE WHEN crlf = 0 AND lf = 0 THEN 'none' WHEN lf = 0 THEN 'crlf' WHEN crlf = 0 THEN 'lf' ELSE 'mixed' END AS style FROM c)"""
BOM = """b AS (SELECT doc_id, path, CASE doc_id % 6 WHEN 1 THEN 'EFBBBF' WHEN 2 THEN 'FFFE' WHEN 3 THEN 'FEFF' WHEN 4 THEN 'FFFE0000' WHEN 5 THEN '0000FEFF' ELSE '' END AS mark,
  CASE doc_id % 6 WHEN 1 THEN 'utf-8' WHEN 2 THEN 'utf-16-le' WHEN 3 THEN 'utf-16-be' WHEN 4 THEN 'utf-32-le' WHEN 5 THEN 'utf-32-be' END AS bom_type, hex(encode(text)) AS h FROM v)"""
#: Page URLs as entries, folders included.
U = r"""p AS (SELECT DISTINCT string_split('/web/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/+$', ''), '/')[3:] AS k FROM pages),
x AS (SELECT k[1:i] AS path_key, i < len(k) AS folder FROM (SELECT k, unnest(range(1, len(k) + 1)) AS i FROM p)),
u AS (SELECT path_key, bool_or(folder) AS is_dir, path_key[-1] AS name, len(path_key) - 1 AS depth, array_to_string(path_key, '/') AS rel
  FROM x WHERE array_to_string(path_key, '/') <> '' GROUP BY path_key)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _matches(df: DataFrame) -> DataFrame:
    return df.select("path", "line", "column", "text")


def _found(where: str, column: str, more: str = "") -> str:
    """SQL of matching lines."""
    return f"WITH {V}, {L} SELECT path, line, strlen(regexp_extract(text, '{column}', 1)) + 1 AS \"column\", text{more} FROM l WHERE {where}"


# Search


@query(_found("contains(text, 'queau')", "^(.*?)queau"))
def grep_basic(spark, sf_dir):
    return _matches(grep.matches(virtual.vfiles(spark, sf_dir), GrepSpec("queau")))


@query(_found("regexp_matches(text, '(?i)é[a-z]*x')", "(?i)^(.*?)é[a-z]*x"))
def grep_ci(spark, sf_dir):
    return _matches(grep.matches(virtual.vfiles(spark, sf_dir), GrepSpec("É[a-z]*x", case_sensitive=False)))


@query(_found("regexp_matches(text, '[[:digit:]]{2,}[^[:alnum:]]')", "^(.*?)[[:digit:]]{2,}[^[:alnum:]]"))
def grep_regex_class(spark, sf_dir):
    return _matches(grep.matches(virtual.vfiles(spark, sf_dir), GrepSpec("[[:digit:]]{2,}[^[:alnum:]]")))


@query(_found(r"regexp_matches(text, '\ban\b|\s(é\w+)$')", r"^(.*?)(?:\ban\b|\s(?:é\w+)$)"))
def grep_word_edges(spark, sf_dir):
    return _matches(grep.matches(virtual.vfiles(spark, sf_dir), GrepSpec(r"\ban\b|\s(é\w+)$")))


@query(_found("regexp_matches(text, 'eau[a-z]*é')", "^(.*?)eau[a-z]*é"))
def grep_column_bytes(spark, sf_dir):
    return _matches(grep.matches(virtual.vfiles(spark, sf_dir), GrepSpec("eau[a-z]*é")))


@query(
    f"""WITH {V}, {L} SELECT path, line, strlen(regexp_extract(text, '^(.*?)queau', 1)) + 1 AS "column", text,
  array_to_string(ls[greatest(1, line - 2):line - 1], chr(10)) AS before, array_to_string(ls[line + 1:line + 2], chr(10)) AS after
  FROM l WHERE contains(text, 'queau')"""
)
def grep_context(spark, sf_dir):
    found = grep.matches(virtual.vfiles(spark, sf_dir), GrepSpec("queau", context_before=2, context_after=2))
    return found.select("path", "line", "column", "text", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


@query(_found(r"contains(text, 'ou') AND regexp_matches(path, '/doc_[^/]*\.(txt|md)$') AND NOT regexp_matches(path, '/doc_1[^/]*$')", "^(.*?)ou"))
def grep_include_exclude(spark, sf_dir):
    return _matches(grep.matches(virtual.vfiles(spark, sf_dir), GrepSpec("ou", include=["*.txt", "*.md"], exclude=["doc_1*"])))


@query(
    f"""WITH {V}, {L} SELECT path, line, strlen(regexp_extract(text, '^(.*?)ou', 1)) + 1 AS "column", text FROM l
  WHERE contains(text, 'ou') ORDER BY string_split(path, '/'), line LIMIT 50"""
)
def grep_capped(spark, sf_dir):
    return _matches(grep.grep(virtual.vfiles(spark, sf_dir), GrepSpec("ou", max_matches=50)))


@query(
    f"""WITH {V}, {L}, m AS (SELECT path FROM l WHERE contains(text, 'ou'))
  SELECT least(count(*), 50) AS total_matches, (SELECT count(*) FROM v) AS files_searched, count(DISTINCT path) AS files_matched, count(*) > 50 AS truncated FROM m"""
)
def grep_summary(spark, sf_dir):
    return grep.summary(virtual.vfiles(spark, sf_dir), GrepSpec("ou", max_matches=50))


@query(_found("contains(text, 'queau') AND (path LIKE '/corpus/fr/%' OR regexp_matches(path, '^/corpus/[^/]*/src0/'))", "^(.*?)queau"))
def grep_multi_root_dedupe(spark, sf_dir):
    files = virtual.vfiles(spark, sf_dir)
    both = grep.union_of_roots(files.where("path like '/corpus/fr/%'"), files.where(F.col("path").rlike("^/corpus/[^/]*/src0/")))
    return _matches(grep.matches(both, GrepSpec("queau")))


@query(_found("contains(text, 'queau') AND doc_id % 5 <> 0", "^(.*?)queau"))
def grep_binary_skip(spark, sf_dir):
    files = virtual.vfiles(spark, sf_dir)
    nul = F.when(F.pmod(F.col("doc_id"), F.lit(5)) == 0, F.concat(F.lit(b"\x00"), F.col("content"))).otherwise(F.col("content"))
    return _matches(grep.matches(files.withColumn("content", nul), GrepSpec("queau")))


@query("SELECT page_id, line, strlen(regexp_extract(t, '^(.*?)<a href', 1)) + 1 AS \"column\" FROM (SELECT page_id, i AS line, ls[i] AS t FROM (SELECT page_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT page_id, string_split(html, chr(10)) AS ls FROM pages))) WHERE contains(t, '<a href')")
def grep_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    return grep.matches(pages, GrepSpec("<a href")).select(F.col("path").cast("long").alias("page_id"), "line", "column")


# Reading


def _read(spark, sf_dir, **options):
    return read.read_text(virtual.vfiles(spark, sf_dir), encoding="utf-8", **options).select("path", "content", "total_lines", "file_size_bytes", "start_line", "end_line", "truncated")


def _read_sql(start: str, end: str, content: str, truncated: str = "false") -> str:
    return f"""WITH {V}, r AS (SELECT path, text, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) AS total_lines, strlen(text) AS file_size_bytes FROM v WHERE text IS NOT NULL),
  q AS (SELECT *, {start} AS start_line, {end} AS end_line FROM r)
  SELECT path, {content} AS content, total_lines, file_size_bytes, start_line, end_line, {truncated} AS truncated FROM q"""


@query(_read_sql("1::BIGINT", "total_lines", "text"))
def read_full(spark, sf_dir):
    return _read(spark, sf_dir)


@query(_read_sql("least(3, total_lines + 1)", "least(6, total_lines)", "array_to_string(ls[3:6], chr(10))"))
def read_slice(spark, sf_dir):
    return _read(spark, sf_dir, offset=3, limit=4)


@query(_read_sql("least(40, total_lines + 1)", "total_lines", "array_to_string(ls[40:], chr(10))"))
def read_offset_past_end(spark, sf_dir):
    return _read(spark, sf_dir, offset=40)


@query(
    _read_sql("1::BIGINT", "total_lines", "CASE WHEN length(text) > 100 THEN text[1:100] || chr(10) || chr(10) || '[TRUNCATED at 100 characters. File has ' || total_lines || ' lines, ' || file_size_bytes || ' bytes. Use offset/limit for specific ranges.]' ELSE text END", "length(text) > 100")
)
def read_max_chars(spark, sf_dir):
    return _read(spark, sf_dir, max_characters=100)


@query(f"WITH {V} SELECT path, len(string_split(text, chr(10))) AS total_lines, length(text) AS n_chars, strlen(text) AS file_size_bytes FROM v")
def read_stats(spark, sf_dir):
    return read.stats(virtual.vfiles(spark, sf_dir))


#: Labelled documents are asked for, and for each one a file that is missing and one outside the allowed folders.
R = f"""{V}, r AS (SELECT doc_id * 3 AS idx, (SELECT any_value(path) FROM v WHERE v.doc_id = labels.doc_id) AS path FROM labels
  UNION ALL SELECT doc_id * 3 + 1, '/corpus/missing/' || doc_id FROM labels UNION ALL SELECT doc_id * 3 + 2, '/elsewhere/' || doc_id FROM labels),
a AS (SELECT r.idx, r.path, v.text AS content, CASE WHEN coalesce(r.path, '') = '' THEN 'INVALID_PATH' WHEN r.path NOT LIKE '/corpus/%' THEN 'ACCESS_DENIED' WHEN v.path IS NULL THEN 'NOT_FOUND' END AS error_code
  FROM r LEFT JOIN v ON r.path = v.path)"""


def _requests(spark, sf_dir):
    files = virtual.vfiles(spark, sf_dir)
    asked = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").join(files.select("doc_id", "path"), "doc_id", "left")
    i = F.col("doc_id")
    three = F.array(F.struct((i * 3).alias("idx"), "path"), F.struct((i * 3 + 1).alias("idx"), F.concat(F.lit("/corpus/missing/"), i).alias("path")), F.struct((i * 3 + 2).alias("idx"), F.concat(F.lit("/elsewhere/"), i).alias("path")))
    return read.read_multiple(asked.select(F.explode(three).alias("r")).select("r.*"), files.select("path", "content"), "utf-8", ["/corpus"])


@query(f"WITH {R} SELECT idx, path, content, error_code FROM a")
def read_multiple(spark, sf_dir):
    return _requests(spark, sf_dir).select("idx", "path", "content", "error_code")


@query(f"WITH {V} SELECT doc_id AS idx, path, CASE doc_id % 4 WHEN 0 THEN text END AS content, CASE doc_id % 4 WHEN 1 THEN 'PERMISSION' WHEN 2 THEN 'IO_ERROR' WHEN 3 THEN 'SYMLINK_ESCAPE' END AS error_code, CASE doc_id % 4 WHEN 1 THEN 'no access' WHEN 2 THEN 'failed to read file' WHEN 3 THEN 'link leads out of the allowed folders' END AS error FROM v")
def read_multiple_errors(spark, sf_dir):
    """Files that are there but cannot be read, or whose real path is elsewhere."""
    files, kind = virtual.vfiles(spark, sf_dir), F.pmod(F.col("doc_id"), F.lit(4))
    files = files.withColumn("content", F.when(~kind.isin(1, 2), F.col("content"))).withColumn("real_path", F.when(kind == 3, F.lit("/elsewhere/x")).otherwise(F.col("path")))
    files = files.withColumn("error", F.when(kind == 1, "no access")).withColumn("error_code", F.when(kind == 1, "PERMISSION"))
    out = read.read_multiple(files.select(F.col("doc_id").alias("idx"), "path"), files.drop("doc_id"), "utf-8", ["/corpus"])
    return out.select("idx", "path", "content", "error_code", "error")


@query(
    f"""WITH {R} SELECT count(*) FILTER (error_code IS NULL) AS success_count, count(*) FILTER (error_code IS NOT NULL) AS error_count,
  string_agg(path || ': ' || CASE error_code WHEN 'NOT_FOUND' THEN 'file not found' ELSE 'access denied' END, chr(10) ORDER BY idx) FILTER (error_code IS NOT NULL) AS errors FROM a"""
)
def read_multiple_summary(spark, sf_dir):
    return read.read_summary(_requests(spark, sf_dir)).withColumn("errors", F.array_join("errors", "\n"))


# Line ends


@query(
    f"""WITH {V}, {EOL} SELECT path, style, crlf, lf, crlf + lf + 1 AS total_lines,
  CASE WHEN style = 'mixed' THEN array_to_string(list_filter(range(1, len(string_split(text, chr(10)))), lambda i: (string_split(text, chr(10))[i][-1] = chr(13)) <> (crlf >= lf)), ',') ELSE '' END AS inconsistent_lines FROM s"""
)
def eol_detect(spark, sf_dir):
    return lines.detect_line_endings(virtual.veol(spark, sf_dir)).withColumn("inconsistent_lines", F.array_join(F.col("inconsistent_lines").cast("array<string>"), ","))


def _change(spark, sf_dir, style):
    out = lines.change_line_endings(virtual.veol(spark, sf_dir), style)
    return out.select("path", "original_style", "new_style", "lines_changed", F.col("new_content").cast("string").alias("new_text"))


@query(f"WITH {V}, {EOL} SELECT path, style AS original_style, CASE WHEN style = 'none' THEN style ELSE 'lf' END AS new_style, crlf AS lines_changed, CASE WHEN style IN ('crlf', 'mixed') THEN replace(text, chr(13) || chr(10), chr(10)) END AS new_text FROM s")
def eol_to_lf(spark, sf_dir):
    return _change(spark, sf_dir, "lf")


@query(
    f"""WITH {V}, {EOL} SELECT path, style AS original_style, CASE WHEN style = 'none' THEN style ELSE 'crlf' END AS new_style, CASE WHEN style IN ('lf', 'mixed') THEN lf ELSE 0 END AS lines_changed,
  CASE WHEN style IN ('lf', 'mixed') THEN replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10)) END AS new_text FROM s"""
)
def eol_to_crlf(spark, sf_dir):
    return _change(spark, sf_dir, "crlf")


# Byte order marks


@query(f"WITH {V}, {BOM} SELECT path, bom_type IS NOT NULL AS has_bom, bom_type, (length(mark) // 2)::INTEGER AS bom_bytes FROM b")
def bom_detect(spark, sf_dir):
    return bom.manage_bom(virtual.vbom(spark, sf_dir), "detect").select("path", "has_bom", "bom_type", "bom_bytes")


@query(f"WITH {V}, {BOM} SELECT path, bom_type IS NOT NULL AS changed, CASE WHEN bom_type IS NOT NULL THEN h END AS new_hex FROM b")
def bom_strip(spark, sf_dir):
    return bom.manage_bom(virtual.vbom(spark, sf_dir), "strip").select("path", "changed", F.hex("new_content").alias("new_hex"))


@query(f"WITH {V}, {BOM} SELECT path, bom_type IS NULL AS changed, CASE WHEN bom_type IS NULL THEN 'EFBBBF' || h END AS new_hex, bom_type IS NOT NULL AS failed FROM b")
def bom_add(spark, sf_dir):
    return bom.manage_bom(virtual.vbom(spark, sf_dir), "add", "utf-8").select("path", "changed", F.hex("new_content").alias("new_hex"), F.col("error").isNotNull().alias("failed"))


# Encodings


#: Fixed values, written out: name, display name, aliases.
LISTED = """('utf-8', 'UTF-8', 'utf8,ascii'), ('utf-16-le', 'UTF-16 LE', 'utf16le,utf-16le'), ('utf-16-be', 'UTF-16 BE', 'utf16be,utf-16be'),
  ('windows-1251', 'Windows-1251', 'cp1251'), ('koi8-r', 'KOI8-R', 'koi8r'), ('koi8-u', 'KOI8-U', 'koi8u'), ('ibm866', 'CP866', 'cp866,dos-866'), ('iso-8859-5', 'ISO-8859-5', 'iso88595,cyrillic'),
  ('windows-1252', 'Windows-1252', 'cp1252'), ('iso-8859-1', 'ISO-8859-1', 'iso88591,latin1'), ('iso-8859-15', 'ISO-8859-15', 'iso885915,latin9'),
  ('windows-1250', 'Windows-1250', 'cp1250'), ('iso-8859-2', 'ISO-8859-2', 'iso88592,latin2'), ('windows-1253', 'Windows-1253', 'cp1253'), ('iso-8859-7', 'ISO-8859-7', 'iso88597,greek'),
  ('windows-1254', 'Windows-1254', 'cp1254'), ('iso-8859-9', 'ISO-8859-9', 'iso88599,latin5'), ('windows-1255', 'Windows-1255', 'cp1255'), ('windows-1256', 'Windows-1256', 'cp1256'),
  ('windows-1257', 'Windows-1257', 'cp1257'), ('windows-1258', 'Windows-1258', 'cp1258'), ('windows-874', 'Windows-874', 'cp874,tis-620')"""


@query(f"SELECT * FROM (VALUES {LISTED}) AS t(name, display_name, aliases)")
def encodings_list(spark, sf_dir):
    return charset.encodings(spark).select("name", "display_name", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'windows-1251' WHEN 1 THEN 'iso-8859-1' WHEN 2 THEN 'utf-8' END AS name FROM documents")
def encoding_alias_lookup(spark, sf_dir):
    asked = F.element_at(F.array(*map(F.lit, ("CP1251", "Latin1", "utf8", "unknown"))), F.pmod(F.col("doc_id"), F.lit(4)).cast("int") + 1)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", charset.canonical(asked).alias("name"))


def _converted(spark, sf_dir, to):
    out = convert.convert_encoding(virtual.vfiles(spark, sf_dir), to, "utf-8")
    return out.select("path", F.hex("new_content").alias("new_hex"), F.col("error_code"))


@query(
    f"""WITH {V} SELECT path, CASE WHEN ok THEN h END AS new_hex, CASE WHEN NOT ok THEN 'ENCODING' END AS error_code FROM (
  SELECT path, coalesce(list_bool_and(list_transform(string_split(text, ''), lambda c: ord(c) < 256)), true) AS ok, array_to_string(list_transform(string_split(text, ''), lambda c: printf('%02X', ord(c))), '') AS h FROM v)"""
)
def convert_latin1_hex(spark, sf_dir):
    return _converted(spark, sf_dir, "latin1")


@query(f"WITH {V} SELECT path, array_to_string(list_transform(string_split(text, ''), lambda c: printf('%04X', ord(c))), '') AS new_hex, NULL::VARCHAR AS error_code FROM v")
def convert_utf16be_hex(spark, sf_dir):
    return _converted(spark, sf_dir, "utf-16-be")


@query()
def convert_cp1251(spark, sf_dir):
    return _converted(spark, sf_dir, "cp1251")


@query(f"WITH {V} SELECT path, CASE WHEN strlen(text) = 0 THEN 'utf-8' WHEN strlen(text) = length(text) THEN 'ascii' ELSE 'utf-8' END AS encoding, CASE WHEN strlen(text) = 0 OR strlen(text) = length(text) THEN 100 ELSE 99 END::INTEGER AS confidence, false AS has_bom FROM v")
def detect_encoding(spark, sf_dir):
    return convert.detect_encoding(virtual.vfiles(spark, sf_dir), "full")


@query(
    """WITH c AS (SELECT source AS path, lang AS charset, (doc_id % 100)::BIGINT AS confidence, n_chars AS weight FROM documents WHERE n_chars > 0),
  g AS (SELECT path, charset, sum(weight)::BIGINT AS w, sum(confidence * weight)::BIGINT AS cw FROM c GROUP BY ALL)
  SELECT path, charset, (cw // w)::INTEGER AS confidence FROM g QUALIFY row_number() OVER (PARTITION BY path ORDER BY w DESC, charset) = 1"""
)
def detect_chunk_vote(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars > 0")
    return charset.vote(docs.select(F.col("source").alias("path"), F.col("lang").alias("charset"), F.pmod(F.col("doc_id"), F.lit(100)).alias("confidence"), F.col("n_chars").alias("weight")))


#: Charsets by doc_id modulo their number, the language whose letters the text is given, and the base letters that get one.
KNOWN = [
    ("windows-1251", "ru", virtual.COMMON_LETTERS), ("koi8-r", "ru", virtual.COMMON_LETTERS), ("ibm866", "ru", virtual.COMMON_LETTERS), ("iso-8859-5", "ru", virtual.COMMON_LETTERS),
    ("windows-1253", "el", virtual.COMMON_LETTERS), ("iso-8859-7", "el", virtual.COMMON_LETTERS), ("windows-1255", "he", virtual.COMMON_LETTERS), ("windows-1256", "ar", virtual.COMMON_LETTERS),
    ("windows-874", "th", virtual.COMMON_LETTERS), ("koi8-u", "uk", virtual.COMMON_LETTERS), ("windows-1254", "tr", "hnscwp"), ("windows-1257", "lt", "hnscwpdr"),
    ("windows-1250", "pl", "hnscwpdr"), ("windows-1252", "fr", "hnscwp"),
]
#: So many letters beyond ASCII must be read right; fewer may also be reported without high confidence.
SURE = 100


@query("SELECT doc_id, CASE doc_id % 14 " + " ".join(f"WHEN {k} THEN '{n}'" for k, (n, *_) in enumerate(KNOWN)) + " END AS charset, true AS told FROM documents")
def detect_charsets(spark, sf_dir):
    """Documents in the letters and charsets of other languages: whether detection reads each as it was written, or (which it may
    only where there are few letters) does not say that it is sure."""
    files = virtual.vcharsets(spark, sf_dir, [(n, charset.LANGUAGES[lang], base) for n, lang, base in KNOWN])
    files = files.withColumn("content", charset.encode_text(F.col("text"), F.col("charset"))["content"]).withColumnRenamed("text", "written")
    read_as = charset.with_text(files, "grep")
    high = F.char_length(F.regexp_replace("written", "[\\x00-\\x7F]", ""))
    told = (F.col("text") == F.col("written")) | ((high < SURE) & (F.col("e.confidence") < charset.HIGH))
    return read_as.select("doc_id", "charset", told.alias("told"))


#: Line numbers run through the documents of a file, in the order of their ids.
STAGED = """n AS (SELECT coalesce(lang, '') AS lang, doc_id % 16 AS bucket, doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
b AS (SELECT *, coalesce(sum(len(ls)) OVER (PARTITION BY lang, bucket ORDER BY doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM n),
r AS (SELECT 'lang=' || lang || '/bucket=' || bucket AS path, (base + i)::BIGINT AS line, ls[i] AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM b))"""


@query(f"WITH {STAGED} SELECT path, line, strlen(regexp_extract(text, '^(.*?)queau', 1)) + 1 AS \"column\", text FROM r WHERE contains(text, 'queau')")
def grep_ranges(spark, sf_dir):
    """Real files, written from the documents and read by ranges of 64 KB."""
    files = virtual.staged_files(spark, sf_dir)
    found = _matches(grep.grep_ranges(files, GrepSpec("queau"), 1 << 16))
    return found.withColumn("path", F.regexp_extract("path", "(lang=[^/]*/bucket=[0-9]+)", 1))


@query()
def detect_ranges(spark, sf_dir):
    """Real files, whose ranges of 4 KB, cut within characters or not, vote on the charset: ASCII or UTF-8, whichever holds more bytes."""
    votes = convert.range_votes(virtual.staged_files(spark, sf_dir), 1 << 12)
    return charset.vote(votes).select(F.regexp_extract("path", "(lang=[^/]*/bucket=[0-9]+)", 1).alias("path"), "charset")


# Listing, searching, trees


def _entries(spark, sf_dir):
    return virtual.entries_of_paths(virtual.vurls(spark, sf_dir), "/web")


@query(f"WITH {U} SELECT name, is_dir, CASE WHEN is_dir THEN '[DIR] ' || name ELSE name END AS label FROM u WHERE depth = 0 AND regexp_matches(name, '^[^/]*\\.[^/]*$')")
def list_dir(spark, sf_dir):
    return search.list_directory(_entries(spark, sf_dir), "*.*")


def _search(where: str, tail: str = "") -> str:
    return f"WITH {U} SELECT '/web/' || rel AS path, is_dir FROM u WHERE {where} {tail}"


@query(_search("regexp_matches(name, '^[^/]*1[^/]*$')"))
def search_glob(spark, sf_dir):
    return search.found_entries(_entries(spark, sf_dir), "*1*").select("path", "is_dir")


@query(_search("NOT contains(rel, '1')"))
def search_exclude_by_name(spark, sf_dir):
    """A pattern without `/` excludes by name at every depth, and what is below."""
    return search.found_entries(_entries(spark, sf_dir), "**", exclude=["*1*"]).select("path", "is_dir")


@query(_search("regexp_matches(rel, '(^|/)[^/]*[0-5]$')"))
def search_doublestar(spark, sf_dir):
    return search.found_entries(_entries(spark, sf_dir), "**/*[0-5]").select("path", "is_dir")


@query(_search("NOT regexp_matches(rel, '(^|/)[^/]*2[^/]*(/|$)')"))
def search_exclude(spark, sf_dir):
    return search.found_entries(_entries(spark, sf_dir), "**", ["**/*2*"]).select("path", "is_dir")


@query(_search("regexp_matches(name, '^[^/]*1[^/]*$')", "ORDER BY path_key LIMIT 20"))
def search_capped(spark, sf_dir):
    return search.search_files(_entries(spark, sf_dir), "*1*", max_results=20)


@query(f"WITH {U} SELECT least(count(*), 20) AS n_files, count(*) >= 20 AS truncated FROM u WHERE regexp_matches(name, '^[^/]*1[^/]*$')")
def search_summary(spark, sf_dir):
    return search.search_summary(_entries(spark, sf_dir), "*1*", max_results=20)


def _tree_sql(where: str = "true", tail: str = "") -> str:
    return f"WITH {U} SELECT rel, repeat('  ', depth::INTEGER) || name || CASE WHEN is_dir THEN '/' ELSE '' END AS line FROM u WHERE {where} {tail}"


def _tree(spark, sf_dir, **options):
    return tree.tree_entries(_entries(spark, sf_dir), **options).select(F.array_join("path_key", "/").alias("rel"), "line")


EVERYTHING = 1 << 30


@query(_tree_sql())
def tree_lines(spark, sf_dir):
    return _tree(spark, sf_dir, max_files=EVERYTHING)


@query(_tree_sql("depth < 2"))
def tree_depth(spark, sf_dir):
    return _tree(spark, sf_dir, max_files=EVERYTHING, max_depth=2)


@query(_tree_sql("is_dir"))
def tree_dirs_only(spark, sf_dir):
    return _tree(spark, sf_dir, max_files=EVERYTHING, dirs_only=True)


@query(_tree_sql("NOT list_bool_or(list_transform(path_key, lambda n: regexp_matches(n, '^[^/]*3[^/]*$')))"))
def tree_exclude(spark, sf_dir):
    return _tree(spark, sf_dir, max_files=EVERYTHING, exclude=["*3*"])


@query(
    f"""WITH {U}, f AS (SELECT *, row_number() OVER (ORDER BY path_key) AS n FROM u),
  k AS (SELECT * FROM f WHERE n <= 25)
  SELECT string_agg(repeat('  ', depth::INTEGER) || name || CASE WHEN is_dir THEN '/' ELSE '' END || chr(10), '' ORDER BY n) AS tree,
  count(*) FILTER (NOT is_dir) AS file_count, count(*) FILTER (is_dir) AS dir_count, (SELECT count(*) > 25 FROM u) AS truncated FROM k"""
)
def tree_capped(spark, sf_dir):
    return tree.tree(_entries(spark, sf_dir), max_files=25)


#: The virtual files as entries, folders included.
E = """k AS (SELECT string_split(path, '/')[3:] AS k, text FROM v),
x AS (SELECT k[1:i] AS path_key, i < len(k) AS is_dir, CASE WHEN i < len(k) THEN NULL WHEN strlen(text) = length(text) AND text <> '' THEN 'ascii' ELSE 'utf-8' END AS label FROM (SELECT k, text, unnest(range(1, len(k) + 1)) AS i FROM k)),
n AS (SELECT DISTINCT path_key, is_dir, label FROM x)"""


@query(
    f"""WITH {V}, {E}, f AS (SELECT *, row_number() OVER (ORDER BY path_key) AS r FROM n), t AS (SELECT * FROM f WHERE r <= 200)
  SELECT string_agg(repeat('  ', len(path_key)::INTEGER - 1) || path_key[-1] || CASE WHEN is_dir THEN '/' ELSE '  [' || label || ']' END || chr(10), '' ORDER BY r) AS tree,
  count(*) FILTER (NOT is_dir) AS file_count, count(*) FILTER (is_dir) AS dir_count, (SELECT count(*) > 200 FROM n) AS truncated FROM t"""
)
def tree_encodings(spark, sf_dir):
    """Encodings are detected for the files that are shown."""
    files = virtual.vfiles(spark, sf_dir)
    return tree.tree(virtual.entries_of_paths(files, "/corpus"), max_files=200, show_encoding=True, contents=files)


@query(f"WITH {U} SELECT rel, name, CASE WHEN is_dir THEN 'directory' ELSE 'file' END AS type FROM u WHERE NOT list_bool_or(list_transform(path_key, lambda n: contains(n, '7')))")
def dir_tree_paths(spark, sf_dir):
    return tree.json_tree_entries(_entries(spark, sf_dir), ["7"]).select(F.array_join("path_key", "/").alias("rel"), "name", "type")


@query(f"WITH {V} SELECT path, (path = '/corpus/fr' OR path LIKE '/corpus/fr/%' OR path LIKE '/corpus/de/src1/%') AS allowed FROM v")
def path_allowed(spark, sf_dir):
    return virtual.vfiles(spark, sf_dir).select("path", policy.path_allowed(F.col("path"), ["/corpus/fr", "/corpus/de/src1"]).alias("allowed"))


# Links

#: Pages as links: two of three lead to the page of half their number; some to themselves or each other, some out of the folder.
LINKS = """k AS (SELECT DISTINCT page_id AS id FROM pages WHERE page_id % 3 <> 0 OR page_id % 30 = 0),
x AS (SELECT '/web/p' || id AS path, CASE WHEN id % 50 = 7 THEN '/web/p' || id WHEN id % 50 = 11 THEN '/web/p' || (id + 2) WHEN id % 50 = 13 THEN '/web/p' || (id - 2)
  WHEN id % 30 = 0 THEN '/elsewhere/' || id ELSE '/web/p' || (id // 2) END AS target FROM k)"""


@query(
    f"""WITH RECURSIVE {LINKS}, w AS (SELECT path, target AS at, 1::BIGINT AS hops FROM x
  UNION ALL SELECT w.path, x.target, w.hops + 1 FROM w JOIN x ON w.at = x.path WHERE w.hops < 64),
e AS (SELECT w.path, w.at, w.hops FROM w LEFT JOIN x ON w.at = x.path WHERE x.path IS NULL)
SELECT x.path, e.at AS real_path, coalesce(e.hops, 0) AS hops, CASE WHEN e.at IS NULL THEN 'IO_ERROR' WHEN e.at NOT LIKE '/web/%' THEN 'SYMLINK_ESCAPE' END AS error_code FROM x LEFT JOIN e ON x.path = e.path"""
)
def links_resolved(spark, sf_dir):
    """Chains of links, with circles and escapes."""
    i = F.col("page_id")
    is_link = (F.pmod(i, F.lit(3)) != 0) | (F.pmod(i, F.lit(30)) == 0)
    to = lambda n: F.concat(F.lit("/web/p"), n.cast("string"))
    target = F.when(F.pmod(i, F.lit(50)) == 7, to(i)).when(F.pmod(i, F.lit(50)) == 11, to(i + 2)).when(F.pmod(i, F.lit(50)) == 13, to(i - 2))
    target = target.when(F.pmod(i, F.lit(30)) == 0, F.concat(F.lit("/elsewhere/"), i.cast("string"))).otherwise(to(F.expr("page_id div 2")))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where(is_link)
    found = links.resolve_links(pages.select(to(i).alias("path"), target.alias("target")), ["/web"])
    return found.withColumn("hops", F.coalesce("hops", F.lit(0).cast("long")))


# Edits


def _edited(spark, sf_dir, edits):
    out = edit.edit_files(virtual.vfiles(spark, sf_dir), edits, "utf-8")
    return out.select("path", F.col("new_content").cast("string").alias("new_text"), "error_code")


@query(f"WITH {V} SELECT path, CASE WHEN p > 0 THEN text[1:p - 1] || 'IT' || text[p + 3:] END AS new_text, CASE WHEN p = 0 THEN 'OPERATION_FAILED' END AS error_code FROM (SELECT *, strpos(text, 'the') AS p FROM v)")
def edit_exact_first(spark, sf_dir):
    return _edited(spark, sf_dir, [("the", "IT")])


@query(
    f"""WITH {V}, a AS (SELECT *, strpos(text, 'e') AS p FROM v), b AS (SELECT *, CASE WHEN p > 0 THEN text[1:p - 1] || 'aa' || text[p + 1:] END AS t FROM a),
  c AS (SELECT *, strpos(t, 'a') AS q FROM b) SELECT path, CASE WHEN q > 0 THEN t[1:q - 1] || 'XY' || t[q + 1:] END AS new_text, CASE WHEN coalesce(q, 0) = 0 THEN 'OPERATION_FAILED' END AS error_code FROM c"""
)
def edit_sequential(spark, sf_dir):
    return _edited(spark, sf_dir, [("e", "aa"), ("a", "XY")])


@query()
def edit_flexible(spark, sf_dir):
    """The first line's words with other blanks around them match only flexibly."""
    files = virtual.vfiles(spark, sf_dir)
    padded = files.withColumn("content", F.concat(F.lit(b"  begin \n\tmiddle\nend\n"), F.col("content")))
    out = edit.edit_files(padded, [("begin\nmiddle", "first\n  second")], "utf-8")
    return out.select("path", F.col("new_content").cast("string").alias("new_text"), "diff", "error_code")


@query()
def edit_diff(spark, sf_dir):
    return edit.edit_files(virtual.vfiles(spark, sf_dir), [("e", "E")], "utf-8").select("path", "diff")


@query("SELECT a, b, (b_1, b_2, b_3) > (a_1, a_2, a_3) AS newer FROM (VALUES ('1.0.0', '1.1.0-beta', 1, 0, 0, 1, 1, 0), ('1.0.0', '2', 1, 0, 0, 2, 0, 0), ('v1.2.3', '1.2.3', 1, 2, 3, 1, 2, 3), ('1.10.0', '1.9.9', 1, 10, 0, 1, 9, 9), ('1.x', '1.0.1', 1, 0, 0, 1, 0, 1)) AS t(a, b, a_1, a_2, a_3, b_1, b_2, b_3)")
def version_compare(spark, sf_dir):
    pairs = spark.createDataFrame([("1.0.0", "1.1.0-beta"), ("1.0.0", "2"), ("v1.2.3", "1.2.3"), ("1.10.0", "1.9.9"), ("1.x", "1.0.1")], "a string, b string")
    return pairs.select("a", "b", text.is_newer(F.col("b"), F.col("a")).alias("newer"))


@query()
def file_info(spark, sf_dir):
    """Metadata of the engine's own sources, as a real directory."""
    import os

    from textlake.sources.fs_entries import fs_entries

    return info.file_info(fs_entries(spark, [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]).where("is_dir or name like '%.py'"))


@query()
def grep_files(spark, sf_dir):
    """The engine's own sources, searched as real files."""
    import os

    from textlake.sources.files import corpus

    files = corpus(spark, [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]).where("path like '%.py'")
    return grep.grep(files, GrepSpec(r"^def \w+", max_matches=EVERYTHING)).select("path", "line", "column", "text")


@query("SELECT * FROM (VALUES ('/corpus'), ('/web')) AS t(directory)")
def allowed_directories(spark, sf_dir):
    return info.allowed_directories(spark, policy.PathPolicy.of(["/corpus", "/web"]))
