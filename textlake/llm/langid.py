"""Language identification by hyperdimensional profiles.

Every letter, and the space, has a random vector of +1 and -1, drawn from its code point. A trigram is the product of
its letters' vectors, each permuted (rotated) by its place; a text is the sum of its trigrams; a language's prototype is
the sum of the texts labelled with it. A text is given the language with which its vector has the largest cosine.

Texts are lower-cased, all but letters become one space. Trigrams have one table of vectors per worker, and a batch of
texts is one matrix product of trigram counts and that table. Training sends one vector per task and language.

Defined cases: a text that is null or has no letter is `und` with score 0, and so is every text if nothing is labelled;
equal cosines go to the first language by name; texts of any length are read whole; repeated rows count each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import text_slices
from textlake.session import ship_package, short_batches

DIM = 1024
UNKNOWN = "und"
#: A worker's table of trigram vectors has so many rows (of DIM bytes) and starts anew when it is full.
MOST_GRAMS = 32_768
#: So many distinct trigrams are looked at together.
STEP = 4_096
#: So many letters' vectors are kept.
MOST_LETTERS = 8_192
_LETTER: np.ndarray | None = None


def is_letter() -> np.ndarray:
    """For every code point, whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


class Grams:
    """Trigram codes and their vectors."""

    def __init__(self, dim: int = DIM):
        self.dim, self.letters = dim, {}
        self.reset()

    def reset(self) -> None:
        self.codes = np.empty(0, dtype=np.int64)  # sorted
        self.rows = np.empty(0, dtype=np.int64)
        if not hasattr(self, "table"):
            self.table = np.empty((MOST_GRAMS, self.dim), dtype=np.int8)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            if len(self.letters) >= MOST_LETTERS:
                self.letters.clear()
            self.letters[c] = (np.random.default_rng([20_011, c]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1).astype(np.int8)
        return self.letters[c]

    def vector(self, code: int) -> np.ndarray:
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def index(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the table for at most STEP sorted distinct codes, which are added if they are new. Rows that were given
        out before may stand for others afterwards."""
        new = codes[~np.isin(codes, self.codes, assume_unique=True)]
        if len(self.codes) + len(new) > len(self.table):
            self.reset()
            new = codes
        if len(new):
            rows = np.arange(len(self.codes), len(self.codes) + len(new))
            for row, code in zip(rows, new.tolist()):
                self.table[row] = self.vector(code)
            self.codes, self.rows = np.concatenate([self.codes, new]), np.concatenate([self.rows, rows])
            order = np.argsort(self.codes, kind="stable")
            self.codes, self.rows = self.codes[order], self.rows[order]
        return self.rows[np.searchsorted(self.codes, codes)]


def trigrams(text: str) -> np.ndarray:
    """Codes of the text's trigrams; none if it has no letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    points = np.where(is_letter()[points], points, 32)
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    if len(points) < 3:
        return np.empty(0, dtype=np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def variety(text: str) -> float:
    """The number of trigrams that count as independent: all where they differ, less where they repeat."""
    counts = np.unique(trigrams(text), return_counts=True)[1].astype(np.float64)
    return float(counts.sum() ** 2 / np.square(counts).sum()) if len(counts) else 0.0


def slices(texts: list[str], most: int = 500_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i - start >= 255:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def train(df: DataFrame, text: Column, lang: Column, dim: int = DIM) -> dict[str, np.ndarray]:
    """A prototype per language from all rows with a language. The result has languages times dim numbers."""
    ship_package(df.sparkSession)
    short_batches(df.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(dim), {}
        for part, texts in text_slices(parts):
            langs = part["lang"].to_pylist()
            for name in sorted(set(langs)):
                own = [t for t, n in zip(texts, langs) if n == name]
                for a, b in slices(own):
                    codes, counts = np.unique(np.concatenate([trigrams(t) for t in own[a:b]]), return_counts=True)
                    total = sums.setdefault(name, np.zeros(dim))
                    for i in range(0, len(codes), STEP):
                        total += counts[i : i + STEP].astype(np.float64) @ grams.table[grams.index(codes[i : i + STEP])]
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [v.astype(np.int64) for v in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.int64()))]))

    labelled = df.select(F.coalesce(text.cast("string"), F.lit("")).alias("text"), lang.cast("string").alias("lang")).where("lang is not null")
    sums = labelled.mapInArrow(run, "lang string, v array<long>")
    cells = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for row in cells.collect():
        out.setdefault(row["lang"], np.zeros(dim))[row["i"]] = row["x"]
    return {name: out[name] for name in sorted(out) if out[name].any()}


def classify(texts: list[str], grams: Grams, prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the best prototype (rows, normalised), or -1, and the cosine."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    for a, b in slices(texts):
        own = [trigrams(t) for t in texts[a:b]]
        flat = np.concatenate(own)
        if not len(flat) or not len(prototypes):
            continue
        of = np.repeat(np.arange(b - a, dtype=np.int32), [len(x) for x in own])
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        codes, bounds = flat[first], np.append(first, len(flat))
        vectors = np.zeros((b - a, grams.dim), dtype=np.float32)
        # A matrix of documents times STEP trigrams at a time, however many there are.
        for i in range(0, len(codes), STEP):
            step = codes[i : i + STEP]
            lo, hi = bounds[i], bounds[i + len(step)]
            at = of[lo:hi].astype(np.int64) * len(step) + np.repeat(np.arange(len(step)), np.diff(bounds[i : i + len(step) + 1]))
            counts = np.bincount(at, minlength=(b - a) * len(step)).reshape(b - a, len(step)).astype(np.float32)
            vectors += counts @ grams.table[grams.index(step)].astype(np.float32)
        norm = np.sqrt(np.square(vectors, dtype=np.float64).sum(axis=1))
        has = (norm > 0) & np.array([len(x) > 0 for x in own])
        cosine = (vectors[has].astype(np.float64) @ prototypes.T) / norm[has, None]
        best[a:b][has], score[a:b][has] = cosine.argmax(axis=1), np.clip(cosine.max(axis=1), 0, 1)
    return best, score


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dim: int = DIM, variety_below: float | None = None) -> DataFrame:
    """df with lang_pred and score, which replace columns of these names. The model goes along with the task: languages times dim numbers.

    With variety_below also variety, of the texts whose score is below it, else null.
    """
    ship_package(df.sparkSession)
    short_batches(df.sparkSession)
    df = df.drop("lang_pred", "score", "variety")
    names = list(prototypes)
    matrix = np.stack([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]) if names else np.empty((0, dim))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(dim)
        for part, texts in text_slices(parts, text_col):
            best, score = classify([t or "" for t in texts], grams, matrix)
            found = [names[i] if i >= 0 else UNKNOWN for i in best]
            out = [*part.columns, pa.array(found, pa.string()), pa.array(score)]
            if variety_below is not None:
                out.append(pa.array([variety(t or "") if s < variety_below else None for t, s in zip(texts, score)], pa.float64()))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    schema = type(df.schema)([*df.schema.fields]).add("lang_pred", "string").add("score", "double")
    if variety_below is not None:
        schema = schema.add("variety", "double")
    return df.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is not learned from: crc32 of the id as text, modulo folds."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train_documents(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from all labelled documents that are not held out."""
    return train(docs.where(~held_out()), F.col("text"), F.col("lang"))


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learned from those that are not held out."""
    model = train_documents(docs)
    # Only the text reaches the prediction; the rest of the row passes by it.
    return predict(docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text")), model).drop("text")
