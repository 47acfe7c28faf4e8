"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are strings of words (lower-case alphanumeric runs; punctuation and spacing don't count). A document holds an item if some
window of it is within k = floor(0.2 m) word edits of the item's m words.

* Embedding: a CGK random walk from a window's first word writes STEPS symbols; at each step it writes the current word and moves on if a
  random bit of (step, word) is set. Edit distance becomes Hamming distance. The walk's first steps depend only on the first words, so
  one walk from a start serves the windows of every item size that begin there. A walk sees about SEEN words, so a longer item is embedded
  from several offsets: edits that crowd in one part of a window leave other parts under the bound.
* Bit sampling: WALKS walks, and in each TABLES tables for each class of item sizes, of KEY sampled steps within the class's size; equal
  keys make (document, start less the offset, item) a candidate. With these numbers a window at the full k edits is found with a chance over 0.99
  (the tests measure it); an unchanged one always.
* Verification: bit-parallel (Myers) search of the item in the region of its candidate starts gives the exact least edit distance.

Which starts are embedded: k edits leave at least m - 2 - 3k of an item's three-word grams whole, so a window with fewer of the items' grams
can't pass the verification; such starts are skipped, unless an offset of a longer item may fall on them. That loses nothing, and every hit still goes through embedding and tables. (An
item too short for that bound makes all starts near any of its words count.)

The items are files of about SLICE_BYTES of text each in the shared folder. One stage holds a block of documents and builds the index of one slice after another
over it (a lone slice: once a worker), so documents are read once and memory doesn't depend on the number of slices.

Defined results: null or wordless texts and items match nothing; equal items each match; repeated rows repeat; a row for each document and
item, at its best place (least distance, then first); an empty table gives no rows; other columns are ignored by find() and kept by
drop_contaminated(). An item that a third of all documents hold costs no more than others: nothing is shuffled."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import hashstore
from .textblock import ALPHANUMERIC, Words, mix

U = np.uint64
PERCENT = 20
STEPS = 64
#: Words that a walk of STEPS sees on average, and words from one offset of an item to the next.
SEEN, STRIDE = STEPS // 2, STEPS // 4
WALKS, TABLES, KEY = 8, 8, 3
SLICE_BYTES = 4 << 20
#: Bytes of documents that are held while several slices pass over them.
HELD_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, distance int, item_words int, similarity double, start_byte long, end_byte long"


def edits(m: int) -> int:
    return m * PERCENT // 100


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, lower=True, solid=ALPHANUMERIC)


def walk(tokens: np.ndarray, at: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """CGK symbols (STEPS x starts) from positions at; past end the symbol is 0."""
    out = np.zeros((STEPS, len(at)), U)
    i = at.copy()
    last = max(0, len(tokens) - 1)
    for j in range(STEPS):
        sym = np.where(i < end, tokens[np.minimum(i, last)], U(0))
        out[j] = sym
        i += ((mix(sym ^ U(seed)) >> U(j)) & U(1)).astype(np.int64)
    return out


def offsets_of(m: int) -> list[int]:
    """Where walks begin in an item of m words: every STRIDE words, and SEEN words before its end."""
    return sorted({*range(0, m - SEEN, STRIDE), max(0, m - SEEN)})


def _seed(walk_number: int) -> int:
    return (0x9E3779B97F4A7C15 * (walk_number + 1)) & 0xFFFFFFFFFFFFFFFF


class Index:
    """Tables of a slice of items."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        arr = pa.array(texts, pa.binary())
        w = words_of(*C.buffers(arr))
        keep = np.flatnonzero(w.counts)
        self.ids = [ids[i] for i in keep]
        self.tokens = [w.hashes[w.first[i] : w.first[i + 1]] for i in keep]
        m = np.array([len(t) for t in self.tokens], np.int64)
        self.m = m
        whole = m - 2 - 3 * (m * PERCENT // 100)
        short = whole < 1
        grams, at = w.grams(3)

        def grams_of(some: np.ndarray) -> np.ndarray:
            rows = np.zeros(len(w.counts), bool)
            rows[keep[some]] = True
            return np.unique(grams[rows[w.doc[at]]])

        self.grams = grams_of(~short)
        far = (m > SEEN) & ~short  # items with several offsets
        self.far_grams, self.far_least = grams_of(far), int(whole[far].min(initial=1 << 30))
        self.far = max((offsets_of(int(x))[-1] + edits(int(x)) for x in m[m > SEEN]), default=0)
        self.single = np.unique(np.concatenate([self.tokens[i] for i in np.flatnonzero(short)])) if short.any() else np.zeros(0, U)
        self.least = int(whole[~short].min(initial=1 << 30))
        self.reach = int(m.max(initial=0) + (m.max(initial=0) * PERCENT // 100))
        parts = [(i, o) for i, x in enumerate(m.tolist()) for o in offsets_of(x)]
        self.item_of = np.array([i for i, _ in parts], np.int64)
        self.offset = np.array([o for _, o in parts], np.int64)
        left = m[self.item_of] - self.offset
        classes = (np.log(np.maximum(left, 1)) / np.log(1.3)).astype(int)
        self.tables: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        flat = np.concatenate(self.tokens) if len(m) else np.zeros(0, U)
        start = np.cumsum(m) - m
        for r in range(WALKS):
            begin = start[self.item_of] + self.offset
            symbols = walk(flat, begin, begin + left, _seed(r))
            for c in np.unique(classes):
                of = np.flatnonzero(classes == c)
                span = int(min(STEPS, max(KEY, left[of].min() * 3 // 2)))
                rng = np.random.default_rng([r, int(c)])
                for t in range(TABLES):
                    steps = np.sort(rng.choice(span, KEY, replace=False))
                    key = self._key(symbols[:, of], steps)
                    order = np.argsort(key, kind="stable")
                    self.tables[r, t, int(c)] = (steps, key[order], of[order])
        self.peq = []
        for t in self.tokens:
            bits: dict[int, int] = {}
            for k, x in enumerate(t.tolist()):
                bits[x] = bits.get(x, 0) | 1 << k
            self.peq.append(bits)

    @staticmethod
    def _key(symbols: np.ndarray, steps: np.ndarray) -> np.ndarray:
        h = symbols[steps[0]]
        for s in steps[1:]:
            h = mix(h * U(0x9FB21C651E98DF25) + symbols[s])
        return h

    def starts(self, w: Words) -> np.ndarray:
        """Positions from which a window may pass the verification."""
        n = len(w)
        g, at = w.grams(3)
        end = np.minimum(np.arange(n) + self.reach, w.first[w.doc + 1])

        def holds(grams: np.ndarray, least: int) -> np.ndarray:
            hits = np.zeros(n + 1, np.int64)
            if len(grams):
                hits[1:][at[np.isin(g, grams)]] = 1
            near = np.cumsum(hits)
            return near[end] - near[:-1] >= least

        active = holds(self.grams, self.least)
        if len(self.single):
            one = np.concatenate([[0], np.cumsum(np.isin(w.hashes, self.single))])
            active |= one[end] > one[:-1]
        if self.far:
            begun = np.concatenate([[0], np.cumsum(holds(self.far_grams, self.far_least))])
            active |= begun[1:] > begun[np.maximum(np.arange(n) - self.far, w.first[w.doc])]
        return np.flatnonzero(active)

    def candidates(self, w: Words, step: int = 20_000) -> dict[tuple[int, int], list[int]]:
        """(row, item) -> starts of windows of which some part's key equals the item's in some table."""
        starts = self.starts(w)
        found: dict[tuple[int, int], set[int]] = {}
        for i in range(0, len(starts), step):
            s = starts[i : i + step]
            for r in range(WALKS):
                symbols = walk(w.hashes, s, w.first[w.doc[s] + 1], _seed(r))
                for (r2, _, _), (steps, keys, parts) in self.tables.items():
                    if r2 != r:
                        continue
                    k = self._key(symbols, steps)
                    lo = np.searchsorted(keys, k)
                    hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == k)
                    for x in hit.tolist():
                        j = int(lo[x])
                        while j < len(keys) and keys[j] == k[x]:
                            part = parts[j]
                            found.setdefault((int(w.doc[s[x]]), int(self.item_of[part])), set()).add(int(s[x] - self.offset[part]))
                            j += 1
        return {k: sorted(v) for k, v in found.items()}

    def best(self, item: int, tokens: list[int]) -> tuple[int, int]:
        """Least edit distance of the item to any window of tokens, and the first window end that has it."""
        return search(self.peq[item], int(self.m[item]), tokens)

    def verify(self, item: int, w: Words, row: int, starts: list[int]) -> tuple[int, int, int] | None:
        """(distance, first word, end word) of the best place among regions of candidate starts."""
        m, k = int(self.m[item]), edits(int(self.m[item]))
        low, high = int(w.first[row]), int(w.first[row + 1])
        best = None
        i = 0
        while i < len(starts):
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= m + 2 * k:
                j += 1
            a, z = max(low, starts[i] - k), min(high, starts[j] + m + 2 * k)
            d, end = self.best(item, w.hashes[a:z].tolist())
            if d <= k and (best is None or d < best[0]):
                # the window's start: the same search from its end backwards
                back = {x: int(format(v, f"0{m}b")[::-1], 2) for x, v in self.peq[item].items()}
                _, n = search(back, m, w.hashes[max(a, a + end - m - k) : a + end].tolist()[::-1], anchored=True)
                best = (d, a + end - n, a + end)
            i = j + 1
        return best


def search(peq: dict[int, int], m: int, tokens: list[int], anchored: bool = False) -> tuple[int, int]:
    """(least edit distance, end) of a pattern against windows of tokens that begin anywhere (anchored: at the first token), bit-parallel."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for i, x in enumerate(tokens, 1):
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | (1 if anchored else 0)) & full
        mh = mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, i
    return best, end


class Slices:
    """The items (item_id, text) as files of at most about SLICE_BYTES of text each, in the shared folder. Tasks hold the index of one at a time."""

    def __init__(self, items: DataFrame):
        spark = items.sparkSession
        self.folder, total = f"{C.shared_dir(spark)}/items-{uuid.uuid4().hex}", items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        packed = items.select(F.col("item_id").cast("long").alias("item_id"), C.text_bytes()).where("item_id is not null")
        n = -(-total // SLICE_BYTES)
        self.count = n if n and packed.repartition(n, F.xxhash64("item_id", "text")).mapInArrow(self._saved(), "n long").agg(F.sum("n")).first()[0] else 0

    def _saved(self):
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            rows = sorted((i, t) for b in batches for i, t in zip(C.column(b, "item_id").to_pylist(), C.column(b, "text").to_pylist(), strict=True))
            n = TaskContext.get().partitionId()
            hashstore.save(folder, f"ids-{n}", np.array([i for i, _ in rows], np.int64))
            hashstore.save(folder, f"sizes-{n}", np.array([len(t) for _, t in rows], np.int64))
            hashstore.save(folder, f"text-{n}", np.frombuffer(b"".join(t for _, t in rows), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)])], ["n"])

        return run

    def index(self, n: int) -> Index:
        """The index of a slice; the last one is kept, so a lone slice is built once by a worker."""
        key = (self.folder, n)
        if key not in _built:
            _built.clear()
            ids, sizes, text = (hashstore.load(self.folder, f"{k}-{n}", t) for k, t in (("ids", np.int64), ("sizes", np.int64), ("text", np.uint8)))
            ends, raw = np.cumsum(sizes), text.tobytes()
            _built[key] = Index(ids.tolist(), [raw[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)])
        return _built[key]

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], Iterator[tuple[int, Index]]]]:
        """Blocks of texts that are held together, and all indexes one after another. With several slices more texts are held, since an index is built for each time."""
        held, size = [], 0
        for b in C.text_blocks(batches):
            held.append(b)
            size += C.column(b, "text").nbytes
            if self.count < 2 or size >= HELD_BYTES:
                yield held, map(self.index, range(self.count))
                held, size = [], 0
        if held:
            yield held, map(self.index, range(self.count))


_built: dict[tuple[str, int], Index] = {}

HIT = pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("item_words", pa.int32()), ("similarity", pa.float64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])


def _find(slices: Slices, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.name for x in HIT]
    for held, indexes in slices.blocks(batches):
        hits = [[[] for _ in range(b.num_rows)] for b in held]
        for index in indexes:
            for b, of in zip(held, hits, strict=True):
                data, offsets = C.buffers(C.column(b, "text"))
                w = words_of(data, offsets)
                for (row, item), starts in sorted(index.candidates(w).items()) if index.ids else ():
                    if got := index.verify(item, w, row, starts):
                        d, first, end = got
                        m, at = int(index.m[item]), int(offsets[row])
                        hit = (index.ids[item], d, m, 1 - d / m, int(w.starts[first]) - at, int(w.ends[end - 1]) - at)
                        of[row].append(dict(zip(names, hit, strict=True)))
        for b, of in zip(held, hits, strict=True):
            some = pa.array(np.array([bool(x) for x in of], bool))
            yield pa.RecordBatch.from_arrays([C.column(b, "doc_id").filter(some), pa.array(of, pa.list_(HIT)).filter(some)], ["doc_id", "hits"])


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text) and item (item_id, text) that it holds. One stage runs all slices of the items over blocks of documents, which are read once."""
    spark = docs.sparkSession
    C.arrow_limits(spark)
    slices = Slices(items)
    if not slices.count:
        return spark.createDataFrame([], SCHEMA)
    kind = "array<struct<item_id:bigint,distance:int,item_words:int,similarity:double,start_byte:bigint,end_byte:bigint>>"
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_bytes())
    return packed.mapInArrow(lambda it: _find(slices, it), f"doc_id long, hits {kind}").select("doc_id", F.inline("hits"))


def _clean(slices: Slices, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held, indexes in slices.blocks(batches):
        dirty = [np.zeros(b.num_rows, bool) for b in held]
        for index in indexes:
            for b, bad in zip(held, dirty, strict=True):
                w = words_of(*C.buffers(C.column(b, "text")))
                for (row, item), starts in index.candidates(w).items() if index.ids else ():
                    if not bad[row]:
                        bad[row] = index.verify(item, w, row, starts) is not None
        for b, bad in zip(held, dirty, strict=True):
            yield b.filter(pa.array(~bad))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    spark = docs.sparkSession
    C.arrow_limits(spark)
    slices = Slices(items)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), C.text_bytes())
    return packed.mapInArrow(lambda it: _clean(slices, it), packed.schema).select("_row.*")
