"""Encodings: the registry, byte order marks, decoding and encoding, detection, and the policies that choose one.

UTF-8, Latin-1 and UTF-16 are built-in expressions; the other charsets go through Arrow batches of Python's codecs.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from textlake.functions.charset_guess import LANGUAGES as LANGUAGES
from textlake.functions.charset_guess import hypotheses

@dataclass(frozen=True)
class Encoding:
    name: str
    display_name: str
    aliases: tuple[str, ...]
    description: str
    codec: str


#: Canonical name, display name, aliases, description, Python codec.
ENCODINGS = (
    Encoding("utf-8", "UTF-8", ("utf8", "ascii"), "Unicode, no conversion", "utf-8"),
    Encoding("utf-16-le", "UTF-16 LE", ("utf16le", "utf-16le"), "Unicode, 16 bits, little end first", "utf-16-le"),
    Encoding("utf-16-be", "UTF-16 BE", ("utf16be", "utf-16be"), "Unicode, 16 bits, big end first", "utf-16-be"),
    Encoding("windows-1251", "Windows-1251", ("cp1251",), "Cyrillic", "cp1251"),
    Encoding("koi8-r", "KOI8-R", ("koi8r",), "Russian", "koi8-r"),
    Encoding("koi8-u", "KOI8-U", ("koi8u",), "Ukrainian", "koi8-u"),
    Encoding("ibm866", "CP866", ("cp866", "dos-866"), "Cyrillic, DOS", "cp866"),
    Encoding("iso-8859-5", "ISO-8859-5", ("iso88595", "cyrillic"), "Cyrillic, ISO", "iso8859-5"),
    Encoding("windows-1252", "Windows-1252", ("cp1252",), "Western European", "cp1252"),
    Encoding("iso-8859-1", "ISO-8859-1", ("iso88591", "latin1"), "Western European, ISO", "latin-1"),
    Encoding("iso-8859-15", "ISO-8859-15", ("iso885915", "latin9"), "Western European with the euro sign", "iso8859-15"),
    Encoding("windows-1250", "Windows-1250", ("cp1250",), "Central European", "cp1250"),
    Encoding("iso-8859-2", "ISO-8859-2", ("iso88592", "latin2"), "Central European, ISO", "iso8859-2"),
    Encoding("windows-1253", "Windows-1253", ("cp1253",), "Greek", "cp1253"),
    Encoding("iso-8859-7", "ISO-8859-7", ("iso88597", "greek"), "Greek, ISO", "iso8859-7"),
    Encoding("windows-1254", "Windows-1254", ("cp1254",), "Turkish", "cp1254"),
    Encoding("iso-8859-9", "ISO-8859-9", ("iso88599", "latin5"), "Turkish, ISO", "iso8859-9"),
    Encoding("windows-1255", "Windows-1255", ("cp1255",), "Hebrew", "cp1255"),
    Encoding("windows-1256", "Windows-1256", ("cp1256",), "Arabic", "cp1256"),
    Encoding("windows-1257", "Windows-1257", ("cp1257",), "Baltic", "cp1257"),
    Encoding("windows-1258", "Windows-1258", ("cp1258",), "Vietnamese", "cp1258"),
    Encoding("windows-874", "Windows-874", ("cp874", "tis-620"), "Thai", "cp874"),
)
BY_NAME = {alias: e for e in ENCODINGS for alias in (e.name, *e.aliases)}
#: Charsets that Spark decodes itself, by canonical name.
BUILT_IN = {"utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "iso-8859-1": "ISO-8859-1"}
#: Byte order marks in the order in which they are tried.
BOMS = (("utf-32-be", b"\x00\x00\xfe\xff"), ("utf-32-le", b"\xff\xfe\x00\x00"), ("utf-8", b"\xef\xbb\xbf"), ("utf-16-be", b"\xfe\xff"), ("utf-16-le", b"\xff\xfe"))

CHUNK = 128 * 1024
HIGH, MINIMUM = 80, 50
DETECTED = "struct<charset:string,confidence:int,has_bom:boolean>"


def lookup(name: str) -> Encoding | None:
    return BY_NAME.get(name.lower())


def require(name: str) -> Encoding:
    if (e := lookup(name)) is None:
        raise ValueError(f"unsupported encoding: {name}")
    return e


def encodings(spark: SparkSession) -> DataFrame:
    """name, display_name, aliases, description, by display name."""
    rows = [(e.name, e.display_name, list(e.aliases), e.description) for e in ENCODINGS]
    return spark.createDataFrame(rows, "name string, display_name string, aliases array<string>, description string").orderBy("display_name")


def aliases(spark: SparkSession) -> DataFrame:
    """alias, name: every name by which an encoding is known. 49 rows, so it can be sent to all tasks."""
    return spark.createDataFrame([(a, e.name) for a, e in BY_NAME.items()], "alias string, name string")


# Byte order marks


def bom_type(content: Column) -> Column:
    """The encoding that the mark at the beginning stands for, or null."""
    out = None
    for name, mark in BOMS:
        hit = F.startswith(content, F.lit(mark))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def bom_size(content: Column) -> Column:
    out = F.lit(0)
    for name, mark in reversed(BOMS):
        out = F.when(bom_type(content) == name, F.lit(len(mark))).otherwise(out)
    return out


def strip_bom(content: Column) -> Column:
    """Without the mark; as it is where there is none."""
    return F.when(bom_size(content) > 0, F.substring(content, bom_size(content) + 1, F.octet_length(content))).otherwise(content)


def add_bom(content: Column, name: str) -> Column:
    """With the encoding's mark before it; null where there already is a mark."""
    mark = dict(BOMS).get(name.lower() if name.lower() in dict(BOMS) else require(name).name)
    if mark is None:
        raise ValueError(f"no byte order mark for {name}")
    return F.when(bom_type(content).isNull(), F.concat(F.lit(mark), content))


# Decoding and encoding


@F.pandas_udf(StringType())
def _decode(content: pd.Series, name: pd.Series) -> pd.Series:
    out = []
    for c, n in zip(content, name):
        out.append(None if c is None or n is None else bytes(c).decode(BY_NAME[n].codec, "replace"))
    return pd.Series(out, dtype="object")


@F.pandas_udf(StructType().add("content", BinaryType()).add("error", StringType()))
def _encode(text: pd.Series, name: pd.Series) -> pd.DataFrame:
    content, error = [], []
    for t, n in zip(text, name):
        data = why = None
        if t is not None and n is not None:
            try:
                data = t.encode(BY_NAME[n].codec)
            except UnicodeEncodeError as e:
                why = f"cannot encode U+{ord(t[e.start]):04X} in {n}"
        content.append(data)
        error.append(why)
    return pd.DataFrame({"content": content, "error": error}, dtype="object")


def canonical(name: Column) -> Column:
    """The canonical name of an encoding's name or alias, or null."""
    pairs = [F.lit(x) for a, e in BY_NAME.items() for x in (a, e.name)]
    return F.element_at(F.create_map(*pairs), F.lower(name))


def decode_text(content: Column, name: Column | str) -> Column:
    """Text of bytes. UTF-8 is not checked, as its bytes pass as they are; elsewhere bad bytes become U+FFFD.

    A byte order mark stays as U+FEFF. With a name known beforehand only its own branch is planned.
    """
    if isinstance(name, str):
        e = require(name)
        if e.name == "utf-8":
            return content.cast("string")
        return F.decode(content, BUILT_IN[e.name]) if e.name == "iso-8859-1" else _decode(content, F.lit(e.name))
    known = canonical(name)
    plain = known.isNull() | (known == "utf-8")
    # The UDF gets nulls for rows that need no codec; Spark may evaluate it for all rows of a batch.
    other = F.when(~plain, content)
    return F.when(plain, content.cast("string")).otherwise(_decode(other, known))


def encode_text(text: Column, name: Column | str) -> Column:
    """struct<content, error>: bytes, or what could not be encoded."""
    if isinstance(name, str):
        e = require(name)
        if e.name == "utf-8":
            return F.struct(text.cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
        return _encode(text, F.lit(e.name))
    return _encode(text, canonical(name))


# Detection


def guess(data: bytes) -> tuple[str, int]:
    """(charset, confidence 0 to 100) without looking at a mark: ASCII, UTF-8, or the likeliest single-byte charset."""
    if data.isascii():
        return "ascii", 100
    try:
        data.decode("utf-8")
        return "utf-8", 99
    except UnicodeDecodeError:
        # A sample may be cut within a character, at both ends.
        rest = data.lstrip(bytes(range(0x80, 0xC0))) if data[:4].strip(bytes(range(0x80, 0xC0))) else b""
        try:
            rest.decode("utf-8")
        except UnicodeDecodeError as e:
            rest = rest[: e.start] if e.start >= len(rest) - 3 and e.reason == "unexpected end of data" else b""
        if not rest.isascii():
            return "utf-8", 90
    return hypotheses().guess(data)


def detect_bytes(data: bytes, mode: str = "full") -> tuple[str, int, bool]:
    """(charset, confidence, has_bom) of a file's bytes.

    full reads all. sample reads of files above CHUNK the first CHUNK bytes; unless these are sure enough (HIGH), it
    decides by the first, the middle and the last CHUNK together. chunked votes over all chunks.
    """
    if mode not in ("full", "sample", "chunked"):
        raise ValueError(f"invalid mode: {mode}")
    for name, mark in BOMS:
        if data.startswith(mark):
            return name, 100, True
    if not data:
        return "utf-8", 100, False
    if mode == "full" or len(data) <= CHUNK:
        return (*guess(data), False)
    if mode == "chunked":
        votes: dict[str, list[int]] = {}
        for i in range(0, len(data), CHUNK):
            name, confidence = guess(data[i : i + CHUNK])
            n = min(CHUNK, len(data) - i)
            total = votes.setdefault(name, [0, 0])
            total[0] += n
            total[1] += confidence * n
        name = min(votes, key=lambda v: (-votes[v][0], v))
        return name, votes[name][1] // votes[name][0], False
    first = guess(data[:CHUNK])
    if first[1] >= HIGH:
        return (*first, False)
    middle = (len(data) - CHUNK) // 2
    return (*guess(data[:CHUNK] + (data[middle : middle + CHUNK] if len(data) > 2 * CHUNK else b"") + data[-CHUNK:]), False)


def _check_mode(mode: str) -> None:
    if mode not in ("full", "sample", "chunked"):
        raise ValueError(f"invalid mode: {mode}")


def _settled(content: Column, mode: str) -> Column:
    """struct<charset, confidence, has_bom> of what built-in functions can tell: marks, empty files, ASCII and UTF-8; else null."""
    row = lambda name, confidence, bom: F.struct(F.lit(name).alias("charset") if isinstance(name, str) else name.alias("charset"), F.lit(confidence).alias("confidence"), F.lit(bom).alias("has_bom"))
    seen = F.when(F.octet_length(content) > CHUNK, F.substring(content, 1, CHUNK)).otherwise(content) if mode == "sample" else content
    marked, text = bom_type(content), seen.cast("string")
    valid = F.is_valid_utf8(text)
    return (
        F.when(marked.isNotNull(), row(marked, 100, True))
        .when(F.octet_length(content) == 0, row("utf-8", 100, False))
        .when(F.octet_length(text) == F.char_length(text), F.when(valid, row("ascii", 100, False)))
        .when(valid, row("utf-8", 99, False))
    )


def detect(content: Column, mode: str = "full") -> Column:
    """struct<charset, confidence, has_bom>. Marks, ASCII and UTF-8 are told by built-in expressions; only the rest of
    the rows carries bytes to Python."""
    _check_mode(mode)

    @F.pandas_udf(DETECTED)
    def other(data: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if d is None else detect_bytes(bytes(d), mode) for d in data]
        return pd.DataFrame(rows, columns=["charset", "confidence", "has_bom"])

    easy = _settled(content, mode)
    return F.coalesce(easy, other(F.when(easy.isNull(), content)))


def with_text(files: DataFrame, policy: str, explicit: str | None = None, default: str = "windows-1251", threshold: int = 64 << 20) -> DataFrame:
    """files (with a column content) plus e, what resolve() gives for the policy, and text, decoded by it.

    Rows whose charset is known beforehand, or told by built-in functions and UTF-8, never leave the JVM. All others go
    through one Arrow operator that detects and decodes in one go; it is planned once, however often its result is used.
    """
    content = F.col("content")
    if explicit is not None:
        name = lookup(explicit)
        e = resolve(content, policy, explicit)
        return files.select("*", e.alias("e"), decode_text(content, name.name if name else "utf-8").alias("text"))

    def mode(size: int) -> str:
        return "full" if policy == "edit" or (policy == "read" and size <= threshold) else "sample"

    found_type = pa.struct([("charset", pa.string()), ("confidence", pa.int32()), ("has_bom", pa.bool_())])
    kind = pa.struct([("found", found_type), ("text", pa.string())])

    # Not deterministic by declaration, so that the optimiser does not copy it to every place that refers to it.
    @F.arrow_udf(f"struct<found:{DETECTED},text:string>")
    def detected(data: pa.Array) -> pa.Array:
        if data.null_count == len(data):
            return pa.nulls(len(data), kind)
        out = []
        for d in data.to_pylist():
            if d is None:
                out.append(None)
                continue
            name, confidence, mark = detect_bytes(d, mode(len(d)))
            e = lookup(name)
            text = d.decode(e.codec, "replace") if e and e.name != "utf-8" else None
            out.append({"found": {"charset": name, "confidence": confidence, "has_bom": mark}, "text": text})
        return pa.array(out, kind)

    easy = _settled(content, "full" if policy == "edit" else "sample")
    if policy == "read":
        easy = F.when(F.octet_length(content) <= threshold, _settled(content, "full")).otherwise(easy)
    # What is easy is a column of its own below the operator, so that filters on the text do not work it out again.
    rows = files.select("*", easy.alias("__s"))
    wide = F.coalesce(F.col("__s.charset").isin(*BUILT_IN), F.lit(False))
    rows = rows.select("*", detected.asNondeterministic()(F.when(F.col("__s").isNull() | wide, content)).alias("__d"))
    e = _resolved(F.coalesce("__s", "__d.found"), policy, default)
    utf8 = F.col("__s.charset").isin("ascii", "utf-8") | F.coalesce(e["name"] == "utf-8", F.lit(True))
    return rows.select(*files.columns, e.alias("e"), F.when(utf8, content.cast("string")).otherwise(F.col("__d.text")).alias("text"))


def vote(chunks: DataFrame) -> DataFrame:
    """From (path, charset, confidence, weight) per chunk to one row per path: the charset with most weight, ties by
    name, and the weighted mean of its confidences, rounded down."""
    chunks = chunks.withColumn("weight", F.greatest("weight", F.lit(1)))  # of an empty file
    sums = chunks.groupBy("path", "charset").agg(F.sum("weight").alias("weight"), F.sum(F.col("confidence") * F.col("weight")).alias("cw"))
    best = sums.groupBy("path").agg(F.min(F.struct((-F.col("weight")).alias("w"), "charset", "cw")).alias("b"))
    return best.select("path", "b.charset", F.expr("b.cw div -b.w").cast("int").alias("confidence"))


# Policies


def resolve(content: Column, policy: str, explicit: str | None = None, default: str = "windows-1251", threshold: int = 64 << 20) -> Column:
    """struct<name, label, confidence, error>: the encoding that an operation uses for a file.

    policy is read, edit, write, grep, convert, tree or detect; they differ in whether an unknown explicit name is an
    error, in whether weak detections are trusted, and in what is used when nothing fits:

    * read: full detection up to threshold bytes, else a sample; weak or unsupported results fall back to UTF-8 and say so;
    * edit: the same on all bytes, without labels;
    * write: a sample; weak or unsupported results fall back to default;
    * grep: a sample, trusted as it is; unknown names and unsupported results are taken as UTF-8;
    * convert: a sample, trusted as it is; unsupported results are errors;
    * tree: a sample; weak results have no label;
    * detect: as found.
    """
    none = F.lit(None).cast("string")
    if explicit is not None:
        e = lookup(explicit)
        if e is None and policy != "grep":
            raise ValueError(f"unsupported encoding: {explicit}")
        return _use(F.lit(e.name if e else "utf-8"), none if policy != "grep" else F.lit(explicit.lower() if e else "utf-8"), F.lit(None))
    if policy == "read":
        found = F.when(F.octet_length(content) <= threshold, detect(content, "full")).otherwise(detect(content, "sample"))
    else:
        found = detect(content, "full" if policy == "edit" else "sample")
    return _resolved(found, policy, default)


def _use(name: Column, label: Column, confidence: Column, error: Column | None = None) -> Column:
    return F.struct(name.alias("name"), label.alias("label"), confidence.cast("int").alias("confidence"), (F.lit(None).cast("string") if error is None else error).alias("error"))


def _resolved(found: Column, policy: str, default: str) -> Column:
    """What a policy makes of a detection."""
    none, utf8 = F.lit(None).cast("string"), F.lit("utf-8")
    name, confidence = found["charset"], found["confidence"]
    known = canonical(name)
    trusted = confidence >= MINIMUM
    if policy == "read":
        label = F.when(~trusted, F.concat(name, F.lit(" (low confidence, using utf-8)"))).when(known.isNull(), F.concat(name, F.lit(" (unsupported, using utf-8)"))).otherwise(name)
        return _use(F.when(trusted & known.isNotNull(), known).otherwise(utf8), label, confidence)
    if policy == "edit":
        return _use(F.when(trusted & known.isNotNull(), known).otherwise(utf8), none, confidence)
    if policy == "write":
        return _use(F.when(trusted & known.isNotNull(), known).otherwise(F.lit(require(default).name)), none, confidence)
    if policy == "grep":
        return _use(F.coalesce(known, utf8), F.when(known.isNotNull(), name).otherwise(utf8), confidence)
    if policy == "convert":
        return _use(known, name, confidence, F.when(known.isNull(), F.concat(F.lit("unsupported encoding: "), F.coalesce(name, F.lit("unknown")))))
    if policy == "tree":
        return _use(known, F.when(trusted, name), confidence)
    if policy == "detect":
        return _use(known, name, confidence)
    raise ValueError(f"unknown policy: {policy}")
