"""Virtual corpora: document and page tables as files, so that operators can be run and checked on tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.session import scratch_path

#: Base letters, common ones first.
COMMON_LETTERS = "etaoinshrdlucmwfygpbvkxjqz"
EXTENSIONS = (".txt", ".md", ".pas")
MARKS = {1: b"\xef\xbb\xbf", 2: b"\xff\xfe", 3: b"\xfe\xff", 4: b"\xff\xfe\x00\x00", 5: b"\x00\x00\xfe\xff"}


def path_of() -> Column:
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), F.pmod(F.col("doc_id"), F.lit(3)).cast("int") + 1)
    return F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), ext)


def vfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, content: every document as a UTF-8 file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", path_of().alias("path"), F.col("text").cast("binary").alias("content"))


def veol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vfiles with other line ends: by doc_id modulo 4 as is, all CRLF, CRLF after full stops only, or none."""
    text, kind = F.col("content").cast("string"), F.pmod(F.col("doc_id"), F.lit(4))
    new = (
        F.when(kind == 1, F.replace(text, F.lit("\n"), F.lit("\r\n")))
        .when(kind == 2, F.replace(text, F.lit(".\n"), F.lit(".\r\n")))
        .when(kind == 3, F.replace(text, F.lit("\n"), F.lit("")))
        .otherwise(text)
    )
    return vfiles(spark, sf_dir).withColumn("content", new.cast("binary"))


def vbom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vfiles with one of five byte order marks, or none, before them, by doc_id modulo 6."""
    mark = F.lit(b"")
    for kind, m in MARKS.items():
        mark = F.when(F.pmod(F.col("doc_id"), F.lit(6)) == kind, F.lit(m)).otherwise(mark)
    return vfiles(spark, sf_dir).withColumn("content", F.concat(mark, F.col("content")))


def entries_of_paths(paths: DataFrame, root: str) -> DataFrame:
    """Entries (path, rel_path, name, depth, path_key, is_dir, is_file) of files below root and the folders above them."""
    at = len(root.rstrip("/")) + 1
    rel = paths.where(F.startswith("path", F.lit(root.rstrip("/") + "/"))).select(F.substring("path", at + 1, 1 << 20).alias("rel")).where("rel <> ''")
    key = rel.select(F.split("rel", "/").alias("key"))
    every = key.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("key")), lambda i: F.struct(F.slice("key", F.lit(1), i).alias("path_key"), (i < F.size("key")).alias("is_dir")))).alias("e"))
    folded = every.groupBy("e.path_key").agg(F.max("e.is_dir").alias("is_dir"))
    rel_path = F.array_join("path_key", "/")
    return folded.select(
        F.concat(F.lit(root.rstrip("/") + "/"), rel_path).alias("path"),
        rel_path.alias("rel_path"),
        F.element_at("path_key", -1).alias("name"),
        (F.size("path_key") - 1).cast("int").alias("depth"),
        "path_key",
        "is_dir",
        (~F.col("is_dir")).alias("is_file"),
    )


def vurls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' URLs as files below /web."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.concat(F.lit("/web/"), F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"/+$", "")).alias("path"), F.col("html").cast("binary").alias("content"))


def vcharsets(spark: SparkSession, sf_dir: str, kinds: list[tuple[str, str, str]]) -> DataFrame:
    """doc_id, charset, text: every document in small letters, some of which are replaced by those of another language, by
    doc_id modulo the number of kinds (charset, letters, the base letters that get one, common ones first)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = F.translate(F.lower(F.coalesce("text", F.lit(""))), "àâäáãçéèêëîïíóôöòúùûüñßœæ", "aaaaaceeeeiiioooouuuunsoa")
    plain = F.regexp_replace(plain, "[^\\x00-\\x7F]", "")
    kind, name, text = F.pmod(F.col("doc_id"), F.lit(len(kinds))), F.lit(None).cast("string"), plain
    for k, (charset, letters, base) in enumerate(kinds):
        # Letters that stand alone: no marks, no final forms, no accents.
        alone = "".join(c for c in letters if len(unicodedata.normalize("NFD", c)) == 1 and unicodedata.category(c)[0] == "L" and c not in "ςםןךףץ") if base == COMMON_LETTERS else letters
        name = F.when(kind == k, F.lit(charset)).otherwise(name)
        text = F.when(kind == k, F.translate(plain, base[: len(alone)], alone[: len(base)])).otherwise(text)
    return docs.select("doc_id", name.alias("charset"), text.alias("text"))


def staged_files(spark: SparkSession, sf_dir: str, buckets: int = 16) -> DataFrame:
    """path, size of real files in the shared folder, written from the documents by language and doc_id modulo buckets, one
    document after another, each with a line feed behind it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.pmod("doc_id", F.lit(buckets)).alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    root = scratch_path(spark, "staged-files")
    dealt = rows.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", "doc_id", "text")
    dealt.select("text", "lang", "bucket").write.partitionBy("lang", "bucket").text(root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
    return found.select("path", F.col("length").alias("size"))
