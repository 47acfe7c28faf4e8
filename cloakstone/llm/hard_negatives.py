"""Hard-negative mining: of each anchor and each of its positives, the highest-scoring rows of other labels within a band of the positive's score.

Components become whole numbers (floor of SCALE times the component), so scores are exact integers. Of a vector's segments the mean and deviation are stored, for one
segment, then LEVELS more finely. The inner product of two segments of n components is n times the means' product, plus or minus at most n times the
deviations' product. Summed over segments, these bounds say whether a pair can reach an anchor's window (from lo to hi); pairs of a block are refined from level to
level, rows and anchors that can reach nothing fall out, and what is left is scored exactly.

Two searches of one kind: positives (same label, no upper end), then negatives (other labels, the band of each positive). Each runs first on a SHARE-th
of the rows: their k-th best score is a lower bound of all rows' k-th best (exact, whatever the share), and raises lo for the run on all rows. So little is
passed on. Anchors are sorted files in the shared folder, FILE anchors each, which tasks map one at a time; a task holds ROWS rows.

Defined results: rows with a null label, id or vector, with null or non-finite components, or of another length than most (ties: the shorter) take no part; a repeated id
counts once, with its highest score, and as an anchor with its least label and vector; an anchor without positives, or a positive without
negatives in its band, gives no row; scores beyond 64 bits are set to the nearest 64-bit number; other columns are ignored."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import hashstore
from .prefix_forest import matrix

SCALE = 256
#: Segments of a vector on each level of refinement.
LEVELS = (1, 4, 16)
#: The first run takes rows whose hash this divides.
SHARE = 64
ROWS, ANCHORS, FILE = 4096, 256, 4096
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Relative room for the rounding of stored summaries (32-bit numbers).
ROOM = 1e-5


def prepared(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label, v (whole numbers as doubles, zeros up to a multiple of the finest segments), s (means and deviations) of the rows that take part."""
    e = F.col(column)
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(e.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).where(~odd & (F.size(e) > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e"))
    top = good.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    good = good.where(F.size("e") == (top[0].d if top else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.floor(SCALE * matrix(C.column(b, "e")))
                v = np.pad(v, ((0, 0), (0, -v.shape[1] % LEVELS[-1])))
                rows = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([C.column(b, "vec_id"), C.column(b, "label"), rows(v), rows(summaries(v))], ["vec_id", "label", "v", "s"])

    return good.mapInArrow(run, "vec_id long, label long, v binary, s binary")


def summaries(v: np.ndarray) -> np.ndarray:
    """Of each level, the means of all segments, then their deviations."""
    out = []
    for n in LEVELS:
        parts = v.reshape(len(v), n, -1)
        out += [parts.mean(2), parts.std(2)]
    return np.concatenate(out, 1).astype(np.float32)


class Block:
    """Rows or anchors in arrays."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, s: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        self.ids, self.labels, self.v, self.s, self.lo, self.hi = ids, labels, v, s, lo, hi

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, at) -> Block:
        part = lambda x: None if x is None else x[at]
        return Block(self.ids[at], self.labels[at], self.v[at], self.s[at], part(self.lo), part(self.hi))

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = 2 * sum(LEVELS[:k])
        s = self.s[:, at : at + 2 * LEVELS[k]].astype(np.float64)
        return s[:, : LEVELS[k]], s[:, LEVELS[k] :]


def bounds(a: Block, b: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) that the inner products of anchors and rows can be, by level k."""
    (ma, da), (mb, db) = a.level(k), b.level(k)
    n = a.v.shape[1] // LEVELS[k]
    means, devs = n * (ma @ mb.T), n * (da @ db.T)
    (m0, d0), (m1, d1) = a.level(0), b.level(0)
    devs += ROOM * (a.v.shape[1] * np.sqrt(m0**2 + d0**2) @ np.sqrt(m1**2 + d1**2).T) + 1e-9
    return means - devs, means + devs


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as 64-bit numbers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(z) for z in r] for r in x.tolist()], object).reshape(x.shape)
    return np.array([[max(LEAST, min(MOST, z)) for z in r] for r in whole(a).dot(whole(b).T)], np.int64)


def hits(a: Block, b: Block, same: bool, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor ids, window, row ids, scores) of the k best pairs of each anchor's window, and all that equal the last."""
    lo, hi = a.lo.min(1).astype(np.float64), a.hi.max(1).astype(np.float64)
    for level in range(len(LEVELS)):
        least, most = bounds(a, b, level)
        may = (most >= lo[:, None]) & (least <= hi[:, None])
        some, rows = may.any(1), may.any(0)
        if not some.any():
            return
        a, lo, hi, b = a[some], lo[some], hi[some], b[rows]
    score = products(a.v, b.v)
    good = ((a.labels[:, None] == b.labels) == same) & (a.ids[:, None] != b.ids)
    for w in range(a.lo.shape[1]):
        fit = good & (score >= a.lo[:, w, None]) & (score <= a.hi[:, w, None])
        if len(b) > k:
            masked = np.where(fit, score, LEAST)
            fit &= score >= np.partition(masked, len(b) - k, axis=1)[:, len(b) - k, None]
        x, y = np.nonzero(fit)
        if len(x):
            # of many equal ones, the least ids
            s = score[x, y]
            order = np.lexsort((b.ids[y], -s, x))
            x, y, s = x[order], y[order], s[order]
            nth = np.arange(len(x)) - np.searchsorted(x, x)
            keep = nth < k
            yield a.ids[x[keep]], np.full(int(keep.sum()), w), b.ids[y[keep]], s[keep]


def _saved(anchors: DataFrame, folder: str, files: int) -> int:
    """anchors (vec_id, label, v, s, lo, hi) as files 0 to files - 1 of arrays. Their number: 0 without anchors, when no task runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId()
        t = [b for b in batches if b.num_rows]
        join = lambda k: b"".join(x for b in t for x in C.column(b, k).to_pylist())
        flat = lambda k: np.concatenate([np.zeros(0, np.int64), *[C.column(b, k).to_numpy() for b in t]]).astype(np.int64)
        lists = lambda k: np.concatenate([np.zeros(0, np.int64), *[C.column(b, k).flatten().to_numpy() for b in t]]).astype(np.int64)
        for name, x in (("ids", flat("vec_id")), ("labels", flat("label")), ("v", np.frombuffer(join("v"), np.float64)), ("s", np.frombuffer(join("s"), np.float32)), ("lo", lists("lo")), ("hi", lists("hi"))):
            hashstore.save(folder, f"{name}-{n}", x)
        yield pa.RecordBatch.from_arrays([pa.array([len(t)])], ["n"])

    total = anchors.repartition(files, "vec_id").sortWithinPartitions("vec_id").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    return files if total else 0


def _loaded(folder: str, n: int) -> Block:
    get = lambda name, kind: hashstore.load(folder, f"{name}-{n}", kind)
    ids = get("ids", np.int64)
    wide = lambda x: x.reshape(len(ids), -1) if len(ids) else np.zeros((0, LEVELS[-1]), x.dtype)
    return Block(ids, get("labels", np.int64), *(wide(get(k, t)) for k, t in (("v", np.float64), ("s", np.float32), ("lo", np.int64), ("hi", np.int64))))


def best(rows: DataFrame, anchors: DataFrame, same: bool, k: int, files: int) -> DataFrame:
    """anchor_id, w, rank, vec_id, score: of each of anchors (prepared, with windows lo and hi: lists of one length) and each window, the k first rows of the same label, or of
    others. A written table."""
    folder = f"{C.shared_dir(rows.sparkSession)}/anchors-{uuid.uuid4().hex}"
    files = _saved(anchors, folder, files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            for n in range(files):
                a = _loaded(folder, n)
                for i in range(0, len(a), ANCHORS):
                    for got in hits(a[i : i + ANCHORS], b, same, k):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["anchor_id", "w", "vec_id", "score"])

    pairs = rows.mapInArrow(run, "anchor_id long, w long, vec_id long, score long").groupBy("anchor_id", "w", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
    out = C.written(pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
    hashstore.remove(rows.sparkSession, folder)
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Prepared rows in blocks of ROWS."""
    held, n = [], 0

    def block() -> Block:
        t = pa.Table.from_batches(held)
        array = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind).reshape(t.num_rows, -1)
        return Block(t["vec_id"].to_numpy(), t["label"].to_numpy(), array("v", np.float64), array("s", np.float32))

    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            held.append(b.slice(i, ROWS))
            n += held[-1].num_rows
            if n >= ROWS:
                yield block()
                held, n = [], 0
    if n:
        yield block()


def _raised(rows: DataFrame, anchors: DataFrame, same: bool, k: int, files: int) -> DataFrame:
    """best() of a part of the rows first, whose k-th scores raise lo for all rows."""
    first = best(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(SHARE)) == 0), anchors, same, k, files)
    low = first.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("low"))  # an anchor has few windows
    more = anchors.join(low, anchors["vec_id"] == low["anchor_id"], "left").drop("anchor_id")
    lo = F.transform("lo", lambda x, w: F.greatest(x, F.coalesce(F.element_at("low", w.cast("long")), F.lit(LEAST))))
    out = best(rows, more.withColumn("lo", F.when(F.col("low").isNull(), F.col("lo")).otherwise(lo)).drop("low"), same, k, files)
    C.dropped(first)
    return out


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, column: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each anchor (a condition on vec_id) and each of its first `positives` other rows of its label,
    the first `negatives` rows of other labels whose scores are from low to high percent of the positive's."""
    rows = C.written(prepared(vectors, column), "prepared")
    chosen = C.written(rows.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v", "s")).alias("r")).select("vec_id", "r.*"), "anchors")
    files = max(1, -(-chosen.count() // FILE))
    whole = chosen.withColumn("lo", F.array(F.lit(LEAST))).withColumn("hi", F.array(F.lit(MOST)))
    near = _raised(rows, whole, True, positives, files)
    # the band in whole numbers: low * p <= 100 * n <= high * p
    p = F.col("score").cast("decimal(38,0)")
    down = lambda x: F.floor(x / 100).cast("long")
    band = near.select("anchor_id", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (-down(-low * p)).alias("lo"), down(high * p).alias("hi"))
    windows = band.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", F.struct("lo", "hi")))).alias("m"))  # of at most `positives` entries
    of = lambda name, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda w: F.coalesce(F.element_at("m", w)[name], F.lit(none).cast("long")))
    asked = chosen.join(windows, chosen["vec_id"] == windows["anchor_id"]).select("vec_id", "label", "v", "s", of("lo", MOST).alias("lo"), of("hi", LEAST).alias("hi"))
    far = _raised(rows, asked, False, negatives, files)
    out = band.join(far.select("anchor_id", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "w"])
    out = C.written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    C.dropped(rows, chosen, near, far)
    return out
