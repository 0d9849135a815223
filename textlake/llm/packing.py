"""Packing of token sequences by minimum bin slack.

A document's ids are cut into full windows and a rest. Full windows are sequences of their own; the rests are packed:
each sequence opens with the longest rest left, and a subset-sum over a bitset (bit s: the rests can add up to s) picks
the multiset of remaining lengths that fills the window closest to capacity. Counts of a length are split in powers of
two, so that the number of shifts follows the distinct lengths; the chosen counts come from tracking back through the
bitsets.

Each task packs its own documents, `flush` rests at a time; only the last sequences of a flush can be short. Sequence
ids are unique over the whole output (input partition, then a counter) and the same when a task runs again.

Defined cases: a null text counts as empty and has the end id only; an empty table gives an empty result; repeated ids
are packed as rows of their own; documents of any length are cut.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from textlake.llm.common import documents, text_slices
from textlake.llm.tokens import LOADED, encoder
from textlake.session import ship_package, short_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def fill(room: int, lengths: list[int], counts: dict[int, int]) -> list[tuple[int, int]]:
    """The (length, count) pairs out of counts whose sum is the largest that is at most room; lengths are ascending."""
    if room <= 0:
        return []
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        n = lengths[i]
        left, k = min(counts[n], room // n), 1
        while left > 0:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= reach << n * k & mask
            left -= k
            k *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, []
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            chosen.append((n, k))
            total -= n * k
    return chosen


def pack(counts: dict[int, int], capacity: int) -> Iterator[list[int]]:
    """Sequences, as lists of lengths, that use up the multiset of lengths."""
    counts = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(counts)

    def take(n: int, k: int) -> None:
        counts[n] -= k
        if not counts[n]:
            del counts[n]
            del lengths[bisect_right(lengths, n) - 1]

    while lengths:
        first = lengths[-1]
        take(first, 1)
        out = [first]
        for n, k in fill(capacity - first, lengths, counts):
            take(n, k)
            out += [n] * k
        yield out


def pack_documents(df: DataFrame, vocab: str, end_id: int = 1, space: str = "dropped", capacity: int = 2048, flush: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship_package(df.sparkSession)
    short_batches(df.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab, space)
        sequence = TaskContext.get().partitionId() << 40
        rests: dict[int, list[tuple]] = defaultdict(list)
        held, rows = 0, []

        def emit(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if len(rows) > least:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COLUMNS)
                rows = []

        def pack_rests() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            for lengths in pack({n: len(x) for n, x in rests.items()}, capacity):
                offset = 0
                for n in lengths:
                    rows.append((*rests[n].pop(), sequence, offset))
                    offset += n
                sequence += 1
                yield from emit(50_000)
            rests.clear()
            held = 0

        for part, texts in text_slices(parts, own=LOADED):
            for doc, ids in zip(part["doc_id"].to_pylist(), enc.encode(texts), strict=True):
                ids += end
                total = len(ids) // 4
                cut = total - total % capacity
                for start in range(0, cut, capacity):
                    rows.append((doc, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), total, sequence, 0))
                    sequence += 1
                if cut < total:
                    rests[total - cut].append((doc, cut, total - cut, zlib.crc32(ids[4 * cut :]), total))
                    held += 1
            yield from emit(50_000)
            if held >= flush:
                yield from pack_rests()
        yield from pack_rests()
        yield from emit(0)

    return documents(df, id_col, text_col).mapInArrow(run, SCHEMA)
