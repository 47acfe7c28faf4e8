"""Approximate nearest neighbours by largest inner product: a forest of hash prefixes.

Each of TREES trees gives every vector a string of SYMBOLS symbols; a symbol is the largest in size of SPAN random projections, with its sign (5 bits).
Vectors get one more component that makes all lengths equal, so the largest inner product is the least angle. A tree's strings stand in sorted
arrays; what shares a prefix with a query is one range of them. A query descends to its longest match and ascends in all trees level by level, within a level tree by tree
(from a tree of its own on), until the ranges hold `needed` strings together; all of these are scored exactly.

On Spark, the first ROUTE symbols say where a string stands. Their counts (TREES * CELLS numbers, a constant) are collected; they tell how far a query
ascends and cut each tree into slots of about SLOT strings, by prefix, and a prefix of more by a hash of the id. A vector goes to one slot of
each tree, a query to those that its range covers; queries stream past a slot's sorted array. Below ROUTE symbols a slot's array goes on by itself, until it
has its share of `needed`.

`needed` is fitted: for SAMPLE queries (those of the least hashes; a bound, not a share) the exact neighbours among all rows are found; for each, the strings that
the query must have gathered before it meets this neighbour. `needed` covers TARGET of them. Uniformly random directions have no near neighbours, so there a large share of the rows is scored; where
neighbours are near, it's few.

Equal vectors are one for the search: of each, the k + 1 least ids can be in an answer and are kept, the others can't (equal scores go to the smaller id).

Defined results: vectors that are null, zero, of another length than most (ties: the shorter), or that hold null or non-finite components take no part, nor do rows without an
id; repeated ids count once, with their highest score (as a query: with the least vector); no rows give no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import common as C

TREES, SYMBOLS, SPAN, BITS = 24, 12, 16, 5
#: Symbols by which strings are routed, and the prefixes that they make.
ROUTE = 2
CELLS = 1 << (ROUTE * BITS)
SLOT = 16384
SAMPLE, TARGET = 64, 0.97
#: Rows that are hashed at once, and queries that are answered at once.
BLOCK = 512
_U = np.uint64


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, v of the rows that take part."""
    v = F.col(column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(v.isNotNull() & F.col("vec_id").isNotNull()).where(~odd & F.exists(v, lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    top = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.where(F.size("v") == (top[0].d if top else 0))


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column, as doubles."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


class Hasher:
    """Strings of vectors: one unsigned 64-bit number a tree, first symbol highest."""

    def __init__(self, dimension: int, longest: float):
        self.longest = longest
        self.directions = np.random.default_rng(11).standard_normal((dimension + 1, TREES * SYMBOLS * SPAN), dtype=np.float32)

    def strings(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) if query else self.longest)
        more = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None] * (not query)
        p = (np.concatenate([x, more], 1).astype(np.float32) @ self.directions).reshape(len(x), TREES, SYMBOLS, SPAN)
        most = np.abs(p).argmax(3)
        symbol = (2 * most + (np.take_along_axis(p, most[..., None], 3)[..., 0] < 0)).astype(_U)
        out = np.zeros((len(x), TREES), _U)
        for k in range(SYMBOLS):
            out = (out << _U(BITS)) | symbol[:, :, k]
        return out


def cells(strings: np.ndarray) -> np.ndarray:
    return (strings >> _U(BITS * (SYMBOLS - ROUTE))).astype(np.int64)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first symbols are equal."""
    x = a ^ b
    out = np.zeros(x.shape, np.int64)
    for k in range(1, SYMBOLS + 1):
        out += (x >> _U(BITS * (SYMBOLS - k))) == 0
    return out


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order whatever the block."""
    return (rows * query).sum(1)


def nearest(scores: np.ndarray, rows: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact scores) of the k nearest by nearly exact scores (-inf: no candidate)."""
    floor = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
    at = np.flatnonzero((scores > -np.inf) & (scores >= floor - 1e-9 * max(1.0, abs(floor) if np.isfinite(floor) else 1.0)))
    s = exact(rows[at], query)
    keep = first(s, ids[at], k)
    return at[keep], s[keep]


class Forest:
    """The fitted parts that go to all tasks: hasher, counts of prefixes, slots, and how many strings a query gathers."""

    def __init__(self, hasher: Hasher, counts: np.ndarray, needed: int, kind: str):
        self.hasher, self.counts, self.needed, self.kind = hasher, counts, needed, kind
        self.slot, self.split, n = np.zeros((TREES, CELLS), np.int64), np.ones((TREES, CELLS), np.int64), 0
        for t in range(TREES):
            for depth in range(ROUTE + 1):
                width = CELLS >> (BITS * depth)
                for i in range(0, CELLS, width):
                    if depth and self.counts[t, i - i % (width << BITS) :][: width << BITS].sum() <= SLOT:
                        continue  # stands in a slot of a shorter prefix
                    size = int(self.counts[t, i : i + width].sum())
                    if size <= SLOT or depth == ROUTE:
                        self.slot[t, i : i + width], self.split[t, i : i + width] = n, max(1, -(-size // SLOT))
                        n += int(self.split[t, i])
        self.slots = n

    def under(self, cell: np.ndarray, depth: int) -> np.ndarray:
        """Of each tree, the strings that share the first `depth` symbols of a query's (cell: of each tree)."""
        width = CELLS >> (BITS * depth)
        return np.array([self.counts[t, c - c % width : c - c % width + width].sum() for t, c in enumerate(cell)])

    def ascended(self, cell: np.ndarray, start: int) -> tuple[np.ndarray, bool]:
        """(of each tree the number of symbols that a query keeps, whether it may keep more than ROUTE in all): tree by tree, from start on."""
        turn = (start + np.arange(TREES)) % TREES
        now = self.under(cell, ROUTE)
        if now.sum() >= self.needed:
            return np.full(TREES, ROUTE), True
        for depth in range(ROUTE - 1, 0, -1):
            up = self.under(cell, depth)
            gathered = now.sum() + np.cumsum((up - now)[turn])
            if gathered[-1] >= self.needed:
                out = np.full(TREES, depth + 1)
                out[turn[: int(np.argmax(gathered >= self.needed)) + 1]] = depth
                return out, False
            now = up
        return np.zeros(TREES, np.int64), False

    def places(self, cell: np.ndarray, keeps: np.ndarray, start: int) -> Iterator[tuple[int, int]]:
        """(tree, slot) that hold a query's ranges. All rows stand in each tree, so without a common prefix one tree is enough."""
        for t in range(TREES) if keeps.any() else [start]:
            width = CELLS >> (BITS * int(keeps[t]))
            i = cell[t] - cell[t] % width
            for s, at in zip(*np.unique(self.slot[t, i : i + width], return_index=True), strict=True):
                yield from ((t, int(s) + k) for k in range(int(self.split[t, i + at])))


def turn_of(ids: np.ndarray) -> np.ndarray:
    """The tree that a query ascends first."""
    return (ids.astype(_U) * _U(0xD6E8FEB86659FD93) >> _U(40)).astype(np.int64) % TREES


def _summary(rows: DataFrame, hasher: Hasher, queries: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """One pass over all rows: kind 0, counts of each tree's cells; kind 1, of each sample query, tree and number of shared symbols, the strings; kind 2, the
    nearest of each sample query in a task."""
    ids, vectors = queries
    of = hasher.strings(vectors, query=True)
    per = SYMBOLS + 1
    place = np.arange(TREES) * per

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, depths = np.zeros(TREES * CELLS, np.int64), np.zeros((len(ids), TREES * per), np.int64)
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, vectors.shape[1])))] * len(ids)
        tree = np.arange(TREES) * CELLS
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                x, own = matrix(C.column(part, "v")), C.column(part, "vec_id").to_numpy()
                h = hasher.strings(x)
                counts += np.bincount((tree + cells(h)).ravel(), minlength=len(counts))
                for q in range(len(ids)):
                    depths[q] += np.bincount((place + shared(h, of[q])).ravel(), minlength=TREES * per)
                    other = own != ids[q]
                    s, who, v = (np.concatenate(z) for z in zip(best[q], (exact(x[other], vectors[q]), own[other], x[other]), strict=True))
                    at = first(s, who, k)
                    best[q] = s[at], who[at], v[at]
        none = lambda n: pa.nulls(n, pa.float64())
        for kind, n in ((0, counts), (1, depths.ravel())):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(n[at]), none(len(at)), pa.nulls(len(at), pa.binary())], ["kind", "at", "n", "score", "v"])
        at = np.repeat(np.arange(len(ids)), [len(x[0]) for x in best])
        if len(at):
            s, who, v = (np.concatenate(z) for z in zip(*best, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 2, np.int32)), pa.array(at), pa.array(who), pa.array(s), pa.array([x.tobytes() for x in v], pa.binary())], ["kind", "at", "n", "score", "v"])

    return rows.mapInArrow(run, "kind int, at long, n long, score double, v binary")


def fit(rows: DataFrame, queries: DataFrame, k: int, sample: int = SAMPLE, target: float = TARGET) -> Forest | None:
    """A forest of rows (vec_id, v); None without rows or queries."""
    longest = rows.select(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("l")).agg(F.max("l")).first()[0]
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not some or longest is None:
        return None
    ids, vectors = np.array([r.vec_id for r in some]), np.array([r.v for r in some], np.float64)
    hasher = Hasher(vectors.shape[1], longest)
    summary = C.written(_summary(rows, hasher, (ids, vectors), k), "forest")
    counts, depths = np.zeros(TREES * CELLS, np.int64), np.zeros((len(ids), TREES, SYMBOLS + 1), np.int64)
    for kind, at, n in summary.where("kind < 2").groupBy("kind", "at").agg(F.sum("n")).collect():
        (counts if kind == 0 else depths.reshape(-1))[at] = n
    near = Window.partitionBy("at").orderBy(F.desc("score"), "n")
    found = summary.where("kind = 2").withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).collect()
    C.dropped(summary)
    of, turn, needs = hasher.strings(vectors, query=True), turn_of(ids), []
    under = depths[:, :, ::-1].cumsum(2)[:, :, ::-1]  # of each query and tree, the strings that share so many symbols or more
    for r in found:
        q = r["at"]
        shares = shared(hasher.strings(np.frombuffer(r.v, np.float64)[None]), of[q][None])[0]
        keeps = int(shares.max())
        if keeps == SYMBOLS:
            needs.append(1)
            continue
        # gathered before the first tree that holds this neighbour is ascended to it
        order = (turn[q] + np.arange(TREES)) % TREES
        before = order[: int(np.argmax(shares[order] == keeps))]
        needs.append(int(under[q, :, keeps + 1].sum() + (under[q, before, keeps] - under[q, before, keeps + 1]).sum()) + 1)
    needs.sort()
    needed = max(k, needs[min(len(needs) - 1, int(np.ceil(target * len(needs))))] if needs else k)
    return Forest(hasher, counts.reshape(TREES, CELLS), needed, "<f4" if rows.schema["v"].dataType.elementType == FloatType() else "<f8")


def _placed(rows: DataFrame, forest, asks: bool) -> DataFrame:
    """slot, asks, depth, share, string, vec_id, v: rows once in each tree, queries in all slots of their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                x, own = matrix(C.column(part, "v")), C.column(part, "vec_id").to_numpy()
                h = f.hasher.strings(x, query=asks)
                cell = cells(h)
                if asks:
                    turn = turn_of(own)
                    ways = [f.ascended(c, int(k)) for c, k in zip(cell, turn, strict=True)]
                    to = [(r, t, s, w[0][t], w[1]) for r, (c, k, w) in enumerate(zip(cell, turn, ways, strict=True)) for t, s in f.places(c, w[0], int(k))]
                    row, tree, slot, depth, deep = (np.array(z, np.int64) for z in zip(*to, strict=True))
                    share = np.where(deep, -(-f.needed // (TREES * f.split[tree, cell[row, tree]])), np.iinfo(np.int64).max)
                else:
                    row, tree = np.repeat(np.arange(len(x)), TREES), np.tile(np.arange(TREES), len(x))
                    c = cell[row, tree]
                    salt = (own[row].astype(_U) * _U(0x9E3779B97F4A7C15) >> _U(33)).astype(np.int64)
                    slot, depth, share = f.slot[tree, c] + salt % f.split[tree, c], np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
                v = pa.array([z.tobytes() for z in x.astype(f.kind)], pa.binary()).take(pa.array(row))
                cols = [pa.array(slot), pa.array(np.full(len(row), asks)), pa.array(depth.astype(np.int32)), pa.array(share), pa.array(h[row, tree].view(np.int64)), pa.array(own[row]), v]
                yield pa.RecordBatch.from_arrays(cols, ["slot", "asks", "depth", "share", "string", "vec_id", "v"])

    return rows.mapInArrow(run, "slot long, asks boolean, depth int, share long, string long, vec_id long, v binary")


class Slot:
    """A sorted array of strings with their vectors."""

    def __init__(self, held: list[pa.RecordBatch], kind: str):
        self.kind = kind
        t = pa.Table.from_batches(held)
        strings = t["string"].to_numpy().view(_U)
        order = np.argsort(strings, kind="stable")
        self.strings, self.ids = strings[order], t["vec_id"].to_numpy()[order]
        self.rows = self._vectors(t["v"])[order]

    def _vectors(self, col) -> np.ndarray:
        return np.frombuffer(b"".join(col.to_pylist()), self.kind).astype(np.float64).reshape(len(col), -1)

    def ranges(self, strings: np.ndarray, depth: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the range that shares its prefix of `depth` symbols; at ROUTE symbols, the longest match, ascended until it holds `share` strings."""
        lo, hi, open_ = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64), np.ones(len(strings), bool)
        for d in range(SYMBOLS, -1, -1):
            at = np.flatnonzero(open_ & ((d == depth) | ((depth == ROUTE) & (d > ROUTE))))
            rest = _U((1 << (BITS * (SYMBOLS - d))) - 1)
            a = np.searchsorted(self.strings, strings[at] & ~rest)
            b = np.searchsorted(self.strings, strings[at] | rest, side="right")
            done = (b - a >= share[at]) | (d == depth[at])
            lo[at[done]], hi[at[done]], open_[at[done]] = a[done], b[done], False
        return lo, hi

    def answer(self, queries: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ids, q = C.column(queries, "vec_id").to_numpy(), self._vectors(C.column(queries, "v"))
        lo, hi = self.ranges(C.column(queries, "string").to_numpy().view(_U), C.column(queries, "depth").to_numpy(), C.column(queries, "share").to_numpy())
        order = np.lexsort((hi, lo))
        same = np.flatnonzero(np.append(True, (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)))
        for some in np.split(order, same[1:]):  # queries of one range are scored together
            a, b = lo[some[0]], hi[some[0]]
            if a == b:
                continue
            rows, who = self.rows[a:b], self.ids[a:b]
            scores = q[some] @ rows.T
            scores[ids[some][:, None] == who] = -np.inf
            for s, i in zip(scores, some, strict=True):
                at, exactly = nearest(s, rows, who, q[i], k)
                if len(at):
                    yield int(ids[i]), who[at], exactly


def _answers(batches: Iterator[pa.RecordBatch], k: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows of _placed sorted by slot, strings before queries -> query_id, vec_ids, scores: the nearest of each query in each slot."""

    def told(slot: Slot, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, queries.num_rows, BLOCK):
            if got := list(slot.answer(queries.slice(i, BLOCK), k)):
                q, who, s = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([w.tolist() for w in who], pa.list_(pa.int64())), pa.array([x.tolist() for x in s], pa.list_(pa.float64()))], ["query_id", "vec_ids", "scores"])

    now, held, slot = None, [], None
    for b in batches:
        key = C.column(b, "slot").to_numpy() * 2 + C.column(b, "asks").to_numpy(zero_copy_only=False)
        for i, j in zip(edges := [0, *(np.flatnonzero(np.diff(key)) + 1).tolist()], [*edges[1:], b.num_rows], strict=True):
            if i == j:
                continue
            at, asks = divmod(int(key[i]), 2)
            if at != now:
                now, held, slot = at, [], None
            if not asks:
                held.append(b.slice(i, j - i))
            elif held or slot:
                slot = slot or Slot(held, kind)
                held = []
                yield from told(slot, b.slice(i, j - i))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, column: str = "embedding", sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: of each of queries (vec_id, column), which are rows of vectors too, the k nearest found among vectors."""
    spark = vectors.sparkSession
    copies = Window.partitionBy("v").orderBy("vec_id")
    rows = C.written(usable(vectors, column).withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    asked = C.written(usable(queries, column).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    forest = fit(rows, asked, k, sample, target)
    if forest is None:
        C.dropped(rows, asked)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = forest.kind
    sent = spark.sparkContext.broadcast(forest)  # of constant size, but for the projections (dimension x a constant)
    placed = _placed(rows, sent, False).unionAll(_placed(asked, sent, True))
    n = max(C.partitions_for(spark), -(-int(forest.counts[0].sum()) * TREES // (1 << 18)))
    told = placed.repartition(min(n, forest.slots), "slot").sortWithinPartitions("slot", "asks").mapInArrow(lambda b: _answers(b, k, kind), "query_id long, vec_ids array<long>, scores array<double>")
    pairs = told.select("query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("p")).groupBy("query_id", F.col("p.vec_ids").alias("vec_id")).agg(F.max("p.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = C.written(pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    C.dropped(rows, asked)
    return out
