"""Token files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

A folder holds shards in ascending document order. Shard k has three files:

* `<name>.ids`: the ids of its documents one after another, little-endian, 16 bits if the vocabulary fits, else 32;
* `<name>.off`: documents + 1 unsigned 64-bit offsets into `.ids`, in ids, from 0;
* `<name>.doc`: the documents' ids, signed 64-bit.

`manifest.json` lists the shards with their bases: the ids before shard k are the prefix sum of the sizes before it, so
a document's global start is base + offset. A shard's name holds a random part: a task that runs again writes new
files, and only those of the attempt that succeeded are listed.

Defined cases: a null text counts as empty and has the end id only; repeated document ids are rows of their own, in the
order of their texts' hashes; a null id is stored as the smallest 64-bit integer, sorts first and is read back as null; an empty
table gives an empty manifest.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.common import documents, text_slices
from textlake.llm.tokens import LOADED, encoder
from textlake.session import ship_package

NO_ID = np.iinfo(np.int64).min
#: Bytes of input for a shard, and ids and documents that are read at once.
SHARD, MOST_TOKENS, MOST_DOCS = 64 << 20, 1 << 20, 5_000


def _fs(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _size(df: DataFrame) -> int:
    """Bytes of the input as Spark's statistics have them, for files what lies on disk; 0 where they are not known."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def _crc32(ids: np.ndarray) -> int:
    """Of the ids as unsigned 32-bit integers, little end first."""
    crc = 0
    for k in range(0, len(ids), MOST_TOKENS):
        crc = zlib.crc32(ids[k : k + MOST_TOKENS].astype("<u4").tobytes(), crc)
    return crc


def write_token_files(df: DataFrame, folder: str, vocab: str, end_id: int, space: str = "attached", n_ids: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write the documents' ids, each document closed by end_id, in ascending order of the id column; gives the manifest.

    Texts are dealt out by ranges of the id, the only exchange; each task then streams its range to one shard. The
    driver sees one row per shard.
    """
    ship_package(df.sparkSession)
    kind = "<u2" if n_ids <= 1 << 16 else "<u4"
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _fs(folder)
        files.create_dir(root, recursive=True)
        shard, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        enc, sizes, docs = encoder(vocab, space), [], []
        ids = None
        for part, texts in text_slices(parts, own=LOADED):
            if ids is None:
                name = f"{shard:06d}-{name}"
                ids = files.open_output_stream(f"{root}/{name}.ids")
            docs.append(part["doc_id"].fill_null(int(NO_ID)).to_numpy(zero_copy_only=False))
            for x in enc.encode(texts):
                x += end
                sizes.append(len(x) // 4)
                ids.write(np.frombuffer(x, "<u4").astype(kind).tobytes())
        if ids is not None:
            ids.close()
            offsets = np.zeros(len(sizes) + 1, dtype="<u8")
            np.cumsum(np.array(sizes, dtype="<u8"), out=offsets[1:])
            for ext, data in (("off", offsets), ("doc", np.concatenate(docs).astype("<i8"))):
                with files.open_output_stream(f"{root}/{name}.{ext}") as out:
                    out.write(data.tobytes())
            row = {"shard": [shard], "name": [name], "n_docs": [len(sizes)], "n_tokens": [int(offsets[-1])]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    # As many shards as the input has SHARD bytes; rows that share an id are told apart by their texts' hashes and can be split.
    n_shards = max(df.sparkSession.sparkContext.defaultParallelism, -(-_size(df) // SHARD))
    ordered = documents(df, id_col, text_col).withColumn("row", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(n_shards, "doc_id", "row").sortWithinPartitions("doc_id", "row", "text").drop("row")
    shards = sorted(ordered.mapInArrow(write, "shard int, name string, n_docs long, n_tokens long").collect())
    bases = np.concatenate([[0], np.cumsum([s.n_tokens for s in shards], dtype="int64")]) if shards else [0]
    manifest = [{"name": s.name, "base": int(b), "n_docs": s.n_docs, "n_tokens": s.n_tokens, "dtype": kind} for s, b in zip(shards, bases)]
    files, root = _fs(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> list[dict]:
    files, root = _fs(folder)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def _array(folder: str, name: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped on a local or mounted path, else read."""
    from pyarrow import fs

    files, root = _fs(folder)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(f"{root}/{name}", dtype=kind, mode="r")
    with files.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.readall(), dtype=kind)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """A row per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit), ids."""
    ship_package(spark)
    manifest = read_manifest(folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    if not manifest:
        return spark.createDataFrame([], schema)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for m in part.to_pylist():
                ids, off, docs = (_array(folder, f"{m['name']}.{ext}", kind) for ext, kind in (("ids", m["dtype"]), ("off", "<u8"), ("doc", "<i8")))
                a = 0
                while a < len(docs):
                    # As many documents as have MOST_TOKENS ids, one at least, and MOST_DOCS at most.
                    cuts = off[a : a + MOST_DOCS + 1].astype("i8")
                    b = a + max(1, int(np.searchsorted(cuts, cuts[0] + MOST_TOKENS, side="right")) - 1)
                    cuts = cuts[: b - a + 1] - cuts[0]
                    wide = ids[off[a] : off[b]]
                    own = np.array(docs[a:b])
                    out = {
                        "doc_id": pa.array(own, mask=own == NO_ID),
                        "start": off[a:b].astype("i8") + m["base"],
                        "n_tokens": np.diff(cuts),
                        "ids_crc32": np.array([_crc32(wide[x:y]) for x, y in zip(cuts[:-1], cuts[1:])], dtype="i8"),
                    }
                    if with_ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(wide.astype("i4")))
                    yield pa.RecordBatch.from_pydict(out)
                    a = b

    rows = [(m["name"], m["base"], m["dtype"]) for m in manifest]
    shards = spark.createDataFrame(rows, "name string, base long, dtype string").coalesce(1).repartition(len(rows))
    return shards.mapInArrow(read, schema)


def token_file_rows(df: DataFrame, folder: str, vocab: str, end_id: int = 0, **options) -> DataFrame:
    """Write the files and return what they hold."""
    write_token_files(df, folder, vocab, end_id, **options)
    return read_token_files(df.sparkSession, folder)
