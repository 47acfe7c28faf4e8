"""Quality rules: importance of a document under hashed n-gram multinomials of a trusted target and of the raw corpus.

Words and word pairs are hashed into BUCKETS cells. One pass counts the cells over all documents (raw) and over all trusted ones
(target); both become smoothed multinomials, and log(target / raw) of a cell is its weight. A document's score is the mean
weight over its n-grams (length-normalised), and it's kept when the score reaches THRESHOLD and the base rules hold. The threshold
is fixed, so the same table always gives the same verdicts. The cell table has a fixed size (BUCKETS doubles, 512 KB) whatever
the corpus, so it's broadcast. The trusted ids are sorted files in the shared folder, dealt by a hash, which workers map and search: no text
is shuffled to its label, and no id list is broadcast or collected.

Defined results: a null or blank text has no words, score 0 and fails the base rule (n_words < 50). Repeated rows and repeated
doc_ids each get their own row. A null doc_id is never trusted. Without trusted rows, all weights are 0. Labels may repeat: a
doc_id is trusted if any of its rows says so. Extra columns are ignored by score() and kept by keep_clean()."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C
from . import hashstore
from .textblock import Words

BUCKETS = 1 << 16
#: Files that the trusted ids are dealt to.
FILES = 1024
#: Mean log-ratio of an n-gram under which a document looks unlike the target: the middle between the least score of labelled good rows (-0.047) and
#: the greatest of labelled bad ones (-0.133), over the 18,251 labelled rows of a table of 51,282 that pass the base rules; none lies on the wrong side.
#: On small tables SMOOTHING draws scores towards 0: of 1,000 rows, 2 of 27 labelled bad ones stay above it, and no good one falls below.
THRESHOLD = -0.09
#: Count added to each cell of either multinomial.
SMOOTHING = 30.0
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def _cells(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of every word and word pair."""
    pairs, at = w.grams(2)
    h = np.concatenate([w.hashes, pairs])
    return (h >> np.uint64(48)).astype(np.int64) % BUCKETS, np.concatenate([w.doc, w.doc[at]])


def _file_of(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FILES)).cast("int").alias("file")


def _store(uri: str):
    """Writes the sorted ids of each file of a partition sorted by file; their numbers go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            hashstore.save(uri, f"trusted-{now}", np.sort(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32())], ["file"])

        for b in batches:
            files, ids = C.column(b, "file").to_numpy(), C.column(b, "doc_id").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)]
            for x, y in zip(cut, cut[1:], strict=False):
                if x < y and files[x] != now:
                    if held:
                        yield done()
                    now, held = int(files[x]), []
                held.append(ids[x:y])
        if held:
            yield done()

    return run


def stored(trusted: DataFrame) -> tuple[str, list[int]]:
    """Folder and numbers of the files of all distinct trusted ids."""
    spark = trusted.sparkSession
    uri = f"{C.shared_dir(spark)}/trusted-{uuid.uuid4().hex}"
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().select("doc_id", _file_of())
    rows = ids.repartition(C.partitions_for(spark), "file").sortWithinPartitions("file").mapInArrow(_store(uri), "file int").collect()  # FILES at most
    return uri, [r.file for r in rows]


def is_trusted(uri: str, files: set[int], b: pa.RecordBatch) -> np.ndarray:
    """Of each row (doc_id, file), whether its id is in the files."""
    there, ids = C.column(b, "doc_id").is_valid().to_numpy(zero_copy_only=False), C.column(b, "doc_id").fill_null(0).to_numpy()
    order = np.argsort(of := C.column(b, "file").to_numpy(), kind="stable")
    out = np.zeros(len(ids), bool)
    for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        if len(at) and int(of[at[0]]) in files:
            known = hashstore.load(uri, f"trusted-{of[at[0]]}", np.int64)
            out[at] = known[np.minimum(np.searchsorted(known, ids[at]), len(known) - 1)] == ids[at]
    return out & there


def _count(uri: str, files: set[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in C.text_blocks(batches):
            cell, row = _cells(Words(*C.buffers(C.column(b, "text")), lower=False))
            trusted = is_trusted(uri, files, b)
            raw += np.bincount(cell, minlength=BUCKETS)
            target += np.bincount(cell[trusted[row]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["cell", "raw", "target"])

    return run


def weights(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(target / raw) of each cell. docs: doc_id, text; trusted: doc_id."""
    uri, files = stored(trusted)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_bytes()).select("doc_id", _file_of(), "text")
    counted = marked.mapInArrow(_count(uri, set(files)), "cell long, raw long, target long").groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for cell, r, t in counted.collect():  # at most BUCKETS rows
        raw[cell], target[cell] = r, t
    return log_ratio(raw, target)


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Both multinomials at the target's size with SMOOTHING added to each cell: a cell too rare to tell weighs about 0."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + SMOOTHING) / (raw * (target.sum() / raw.sum()) + SMOOTHING))


def base_counts(data: np.ndarray, offsets: np.ndarray, w: Words) -> dict[str, np.ndarray]:
    """The plain counts of each row."""
    n = len(offsets) - 1
    row_sum = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets])
    first_byte = (data & 0xC0) != 0x80
    space = (data == 0x20) | ((data >= 9) & (data <= 13))
    out = {"n_words": w.counts, "word_chars": row_sum(first_byte & ~space), "n_symbols": row_sum(_SYMBOL[data])}
    # words within three-word windows that come twice or more
    g, at = w.grams(3)
    repeat = np.zeros(len(w) + 3, bool)
    if len(g):
        key = g ^ (w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:]
        hit = at[order[same]]
        for d in range(3):
            repeat[hit + d] = True
    out["n_repeat_words"] = np.bincount(w.doc[repeat[: len(w)]], minlength=n)
    # lines with a word that equal an earlier line of the same row
    dup = np.zeros(n, np.int64)
    raw = data.tobytes()
    for i in np.flatnonzero(row_sum(data == 10)):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.split()]
        dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    return out


def _score(table: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.text_blocks(batches):
            data, offsets = C.buffers(C.column(b, "text"))
            w = Words(data, offsets, lower=False)
            cell, row = _cells(w)
            n = len(offsets) - 1
            score = np.bincount(row, weights=table[cell], minlength=n) / np.maximum(1, np.bincount(row, minlength=n))
            c = base_counts(data, offsets, w)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            done = {"doc_id": C.column(b, "doc_id")} | {k: pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            done |= {"base_failed": pa.array(failed), "score": pa.array(score), "kept": pa.array(~failed & (score >= threshold))}
            for name in b.schema.names:
                if name not in ("doc_id", "text"):
                    done[name] = C.column(b, name)
            yield pa.RecordBatch.from_arrays(list(done.values()), list(done))

    return run


def score(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row of counts, score and verdict for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    C.arrow_limits(spark)
    table = spark.sparkContext.broadcast(weights(docs, trusted))  # BUCKETS doubles
    return docs.select("doc_id", C.text_bytes()).mapInArrow(lambda it: _score(table.value, threshold)(it), SCHEMA)


def keep_clean(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    spark = docs.sparkSession
    C.arrow_limits(spark)
    table = spark.sparkContext.broadcast(weights(docs, trusted))
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), "doc_id", C.text_bytes())
    schema = StructType.fromDDL(SCHEMA).add("_row", packed.schema["_row"].dataType)
    return packed.mapInArrow(lambda it: _score(table.value, threshold)(it), schema).where("kept").select("_row.*")
