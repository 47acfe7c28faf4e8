"""Quality classifier by nearest-neighbour voting in a latent semantic space.

A document's terms are its words, hashed into TERMS cells (1 + log frequency, idf of the fitting sample, unit length), and a few shape terms:
bands of its length, word length, repetition, symbols, capitals and non-letters. A truncated SVD of the fitting sample maps terms to
DIMENSIONS; latent vectors are of unit length. The fitting sample is bounded: at most PER_CLASS labelled rows of each class, those whose
doc_id has the least hash. Its vectors (8192 x 48 floats, 1.6 MB) and the projection (0.8 MB) are broadcast. Every document's exact
cosines to all of them are computed in blocks, and the labels of its NEIGHBOURS nearest ones vote, weighted by similarity; votes are
set back to the classes' true shares, since the sample holds as many rows of the rarer class as it can.

Defined results: null and empty texts have no words; their shape terms still place them, so they get a score too; without labelled rows of
either class all scores are that class's label (0 without any); labels may repeat or contradict (the sample then holds each row); null labels
and ids are not learned from; ties between neighbours go to the lower position in the sample, which is ordered; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .quality_rules import base_counts
from .textblock import Words

TERMS = 4096
DIMENSIONS = 48
PER_CLASS = 4096
NEIGHBOURS = 24
#: A neighbour weighs its cosine to this power: with many neighbours the nearest ones must count for more.
POWER = 4
#: Decimals of a cosine that count; products of blocks of other shapes differ behind them.
PLACES = 5
THRESHOLD = 0.7
#: Length of the shape terms' part beside the words' unit length.
SHAPE = 1.0
FOLDS, HELD = 4, 2

_BANDS = {
    "length": (1, 10, 30, 50, 100, 200, 500, 1000, 3000, 10000),
    "word_length": (2, 3, 4, 4.5, 5, 5.5, 6, 7, 8, 10),
    "repeat": (0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9),
    "dup_lines": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "symbols": (0.001, 0.005, 0.02, 0.05, 0.1, 0.2, 0.5),
    "capitals": (0.01, 0.03, 0.06, 0.1, 0.2, 0.5, 0.9),
    "marks": (0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.25, 0.4),
    "variety": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
}
SHAPES = sum(len(x) + 1 for x in _BANDS.values())
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))


def terms(b: pa.RecordBatch) -> np.ndarray:
    """Dense rows: TERMS cells of 1 + log frequency, then SHAPES one-hot bands."""
    data, offsets = C.buffers(C.column(b, "text"))
    w = Words(data, offsets, lower=False)
    n = len(offsets) - 1
    cell = (w.hashes >> np.uint64(52)).astype(np.int64)
    tf = np.bincount(w.doc * TERMS + cell, minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)
    np.log1p(tf, out=tf)
    c = base_counts(data, offsets, w)
    row_sum = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets])
    words, chars, lines = np.maximum(1, c["n_words"]), np.maximum(1, c["word_chars"]), 1 + row_sum(data == 10)
    distinct = np.count_nonzero(tf, axis=1)
    values = {
        "length": c["n_words"], "word_length": c["word_chars"] / words, "repeat": c["n_repeat_words"] / words, "dup_lines": c["n_dup_lines"] / lines,
        "symbols": c["n_symbols"] / words, "capitals": row_sum(_UPPER[data]) / chars, "marks": row_sum(_MARK[data]) / chars, "variety": distinct / np.minimum(words, TERMS),
    }
    shape = np.zeros((n, SHAPES), np.float32)
    at = 0
    for name, edges in _BANDS.items():
        shape[np.arange(n), at + np.searchsorted(edges, values[name], side="right")] = 1
        at += len(edges) + 1
    return np.concatenate([tf, shape], 1)


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Words by idf at unit length, shapes at length SHAPE."""
    words = x[:, :TERMS] * idf
    words /= np.maximum(1e-9, np.linalg.norm(words, axis=1, keepdims=True))
    return np.concatenate([words, x[:, TERMS:] * np.float32(SHAPE / np.sqrt(len(_BANDS)))], 1)


class Model:
    """idf, projection (terms x dimensions), unit latent vectors and labels of the fitting sample, and the weight of each class's votes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shares: tuple[float, float]):
        self.y = y.astype(np.float32)
        df = (x[:, :TERMS] > 0).sum(0)
        self.idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 1
        a = weighted(x, self.idf)
        # randomised range finder, a fixed start, two power steps
        k = min(DIMENSIONS, *a.shape)
        q = a @ np.random.default_rng(7).standard_normal((a.shape[1], k + 8)).astype(np.float32)
        for _ in range(2):
            q, _ = np.linalg.qr(q)
            q = a @ (a.T @ q)
        q, _ = np.linalg.qr(q)
        self.projection = np.ascontiguousarray(np.linalg.svd(q.T @ a, full_matrices=False)[2][:k].T)
        self.vectors = self.latent(a)
        in_sample = np.array([(y == 0).sum(), (y == 1).sum()])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.weight = np.where(in_sample > 0, np.array(shares) / in_sample, 0).astype(np.float32)

    def latent(self, a: np.ndarray) -> np.ndarray:
        z = a @ self.projection
        return z / np.maximum(1e-9, np.linalg.norm(z, axis=1, keepdims=True))

    def score(self, x: np.ndarray, rows: int = 256) -> np.ndarray:
        out = np.empty(len(x))
        k = min(NEIGHBOURS, len(self.y))
        of = self.weight[self.y.astype(int)]
        for i in range(0, len(x), rows):
            cos = np.round(self.latent(weighted(x[i : i + rows], self.idf)) @ self.vectors.T, PLACES)
            # one number orders by cosine, then by position
            rank = np.rint(cos * 10**PLACES).astype(np.int64) * len(self.y) - np.arange(len(self.y))
            near = np.sort(np.argpartition(-rank, k - 1, axis=1)[:, :k], axis=1)
            w = np.maximum(np.take_along_axis(cos, near, 1), 0) ** POWER * of[near] + 1e-12
            out[i : i + rows] = (w * self.y[near]).sum(1) / w.sum(1)
        return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample's term rows, sparse: label, cells and values."""
    for b in C.text_blocks(batches, limit=1 << 20):
        x = terms(b)
        at = [np.flatnonzero(r) for r in x]
        yield pa.RecordBatch.from_arrays([C.column(b, "doc_id"), C.column(b, "label"), pa.array([k.astype(np.uint16).tobytes() for k in at], pa.binary()), pa.array([r[k].tobytes() for r, k in zip(x, at, strict=True)], pa.binary())], ["doc_id", "label", "at", "v"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | float:
    """A model of docs (doc_id, text) by labels (doc_id, label 0 or 1), at most per_class of each; or the score of all texts if only one class, or none, is labelled."""
    spark = docs.sparkSession
    C.arrow_limits(spark)
    known = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    total = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(total) < 2:
        return float(max(total, default=0))
    # the least hashes of each class, from the least of each input split
    sample = None
    for y in (0, 1):
        part = known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        sample = part if sample is None else sample.unionAll(part)
    sample = spark.createDataFrame(sample.toPandas(), "doc_id long, label int")  # 2 * per_class rows at most
    chosen = docs.select("doc_id", C.text_bytes()).join(F.broadcast(sample), "doc_id")
    rows = sorted(chosen.select("doc_id", "label", "text").mapInArrow(_vectors, "doc_id long, label int, at binary, v binary").collect())
    x = np.zeros((len(rows), TERMS + SHAPES), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.v, np.float32)
    y = np.array([r.label for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y.max(initial=0))
    n = sum(total.values())
    return Model(x, y, (total[0] / n, total[1] / n))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    C.arrow_limits(spark)
    source = docs.select("doc_id", held_out().alias("held_out"), C.text_bytes())
    schema = "doc_id long, held_out boolean, score double"
    if isinstance(model, float):
        out = source.select("doc_id", "held_out", F.lit(model).alias("score"))
    else:
        known = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in C.text_blocks(batches, limit=1 << 20):
                yield pa.RecordBatch.from_arrays([C.column(b, "doc_id"), C.column(b, "held_out"), pa.array(known.value.score(terms(b)))], ["doc_id", "held_out", "score"])

        out = source.mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
