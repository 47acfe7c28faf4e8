"""Interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted hash arrays that workers memory-map.

Words are lower-cased (A-Z) runs outside white space; each text ends with an end token and begins after a begin mark.

1. Words: each task merges its (hash, count) pairs; buckets by the hash's top bits get sorted hash arrays. A word's number is its rank
   over all buckets.
2. Bigrams: each task merges its (context, word) pairs of numbers; buckets get sorted arrays of a bijective 64-bit hash of the pair, with
   counts. Pairs meet by context; the few contexts with over 1/256 of all tokens (256 at most) and the begin mark are dealt by word
   instead, so no frequent word lands in one task.
3. From each bucket, per context the numbers of pairs seen once, twice and more, and per word the number of distinct contexts go to the
   word's bucket as sums, for the Kneser-Ney lower order.
4. Scoring maps the arrays and looks up each distinct word and pair of a block of documents.

    p(w|u) = max(c(uw) - D(c(uw)), 0) / c(u) + gamma(u) p(w)      p(w) = max(N(w) - D'(N(w)), 0) / N + gamma' / (V + 1)

D, D' are the modified discounts from the counts of counts of either order; N(w) counts distinct contexts of w. An unseen context has gamma 1;
an unseen word has N(w) = 0. Nothing is pruned. Counts are 64-bit (stored in as few bytes as a bucket needs). Number of words: under
2**32 - 1. The number of buckets grows with the text, so a bucket stays of the size that a worker sorts at once.

Defined results: null and empty texts are just the end token; repeated rows count each time; a null doc_id is never held out (it is trained
on); an empty training set scores all tokens as unseen in a vocabulary of 0 words; other columns are ignored."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import hashstore
from .textblock import Words, mix

U = np.uint64
END = U(0x656E642D6F662D74)
BEGIN = 0xFFFFFFFF
HELD = 10
#: Share of tokens from which a context is dealt by word.
HOT = 256
#: Pairs that a task merges at once.
MERGE = 6 << 20
#: Bytes of text for one bucket: a bucket is what a worker sorts at once.
BUCKET_BYTES = 32 << 20


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(HELD)) == 0, F.lit(False))


@dataclass
class Model:
    uri: str
    buckets: int
    first: np.ndarray  # number of each bucket's first word; at the end: all
    tokens: int = 0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    discounts: np.ndarray = field(default_factory=lambda: np.zeros((2, 4)))  # by order, by min(count, 3)
    contexts: int = 0  # N
    begin: np.ndarray = field(default_factory=lambda: np.zeros(4))  # the begin mark's count, and its pairs seen 1, 2, 3+ times
    words_over: float = 0.0  # gamma'

    @property
    def words(self) -> int:
        return int(self.first[-1])


def sequence(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes with an end token after each row, row of each, whether it's the row's first)."""
    w = Words(*C.buffers(C.column(b, "text")), lower=True)
    n = len(w.counts)
    doc = np.concatenate([w.doc, np.arange(n)])
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    return np.concatenate([w.hashes, np.full(n, END, U)])[order], doc, first


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k = k[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], (np.add.reduceat(c[order], at) if len(k) else c)


def _merged(parts: Iterator[tuple[np.ndarray, np.ndarray]], limit: int = MERGE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of (keys, counts), over as many parts as memory allows."""
    keys, counts, n = [], [], 0
    for k, c in parts:
        keys.append(k)
        counts.append(c)
        n += len(k)
        if n > limit:
            k, c = _summed(keys, counts)
            keys, counts, n = [k], [c], len(k)
            if n > limit // 2:
                yield k, c
                keys, counts, n = [], [], 0
    if keys:
        yield _summed(keys, counts)


def _dealt(bucket: np.ndarray, blob_of, buckets: int) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cut)).tolist()
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blob_of(order[cut[k] : cut[k + 1]]) for k in some], pa.binary())], ["bucket", "blob"])


def _shift(buckets: int) -> np.uint64:
    return U(64 - (buckets.bit_length() - 1))


def _count_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (np.unique(sequence(b)[0], return_counts=True) for b in C.text_blocks(batches))
        for k, c in _merged(parts):
            yield _dealt((k >> _shift(buckets)).astype(np.int64), lambda o: np.array([len(o)], np.int64).tobytes() + k[o].tobytes() + c[o].astype(np.int64).tobytes(), buckets)  # noqa: B023

    return run


def _store_words(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, blobs in C.by_bucket(batches):
            keys, counts = [], []
            for x in blobs:
                n = int(np.frombuffer(x, np.int64, 1)[0])
                keys.append(np.frombuffer(x, U, n, 8))
                counts.append(np.frombuffer(x, np.int64, n, 8 + 8 * n))
            key, count = _summed(keys, counts)
            hashstore.save(uri, f"words-{k}", key)
            hashstore.save(uri, f"counts-{k}", count)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(key)], pa.int64()), pa.array([int(count.sum())], pa.int64())], ["bucket", "words", "tokens"])

    return run


def _hot(uri: str, buckets: list[int], first: np.ndarray, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in C.column(b, "bucket").to_pylist():
                at = np.flatnonzero(hashstore.load(uri, f"counts-{k}", np.int64) >= least)
                yield pa.RecordBatch.from_arrays([pa.array(at + int(first[k]), pa.int64())], ["id"])

    return run


def _numbers(m: Model, hashes: np.ndarray) -> np.ndarray:
    """Numbers of sorted distinct hashes; -1: unseen."""
    out = np.full(len(hashes), -1, np.int64)
    cut = np.searchsorted((hashes >> _shift(m.buckets)).astype(np.int64), np.arange(m.buckets + 1))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        q = hashes[cut[k] : cut[k + 1]]
        n = int(m.first[k + 1] - m.first[k])
        if len(q) and n:
            known = hashstore.load(m.uri, f"words-{k}", U)
            at = np.minimum(np.searchsorted(known, q), n - 1)
            out[cut[k] : cut[k + 1]] = np.where(known[at] == q, at + m.first[k], -1)
    return out


def _gather(m: Model, ids: np.ndarray, name: str, kind) -> np.ndarray:
    """Values of sorted ids (none negative) from the words' arrays."""
    out = np.zeros(len(ids), kind)
    cut = np.searchsorted(ids, m.first)
    for k in np.flatnonzero(np.diff(cut)).tolist():
        out[cut[k] : cut[k + 1]] = hashstore.load(m.uri, f"{name}-{k}", kind)[ids[cut[k] : cut[k + 1]] - m.first[k]]
    return out


def _pairs(m: Model, b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(numbers of distinct words, index of each token's word, numbers of tokens, numbers of their contexts, rows)."""
    h, doc, first = sequence(b)
    names, at = np.unique(h, return_inverse=True)
    number = _numbers(m, names)
    word = number[at]
    context = np.empty(len(word), np.int64)
    context[1:] = word[:-1]
    context[first] = BEGIN
    return number, at, word, context, doc


def _pair_bucket(m: Model, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    hot = np.isin(context, m.hot)
    return (mix(np.where(hot, word, context).astype(U)) % U(m.buckets)).astype(np.int64)


def _narrow(c: np.ndarray) -> np.ndarray:
    """Counts in the least of 1, 2, 4 or 8 bytes that holds the largest."""
    return c.astype(np.min_scalar_type(int(c.max(initial=0))))


def _wide(raw: np.ndarray, n: int) -> np.ndarray:
    """The n counts of _narrow() from their bytes."""
    return raw.view(f"u{len(raw) // n}") if n else raw


def _count_pairs(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for b in C.text_blocks(batches):
                _, _, word, context, _ = _pairs(m, b)
                yield np.unique((context.astype(U) << U(32)) | word.astype(U), return_counts=True)

        for key, c in _merged(parts()):
            u, v = (key >> U(32)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.int64)

            def blob(o: np.ndarray) -> bytes:
                at = np.flatnonzero(np.concatenate([[True], u[o][1:] != u[o][:-1]]))  # noqa: B023
                n = np.diff(np.append(at, len(o)))
                return np.array([len(at), len(o)], np.int64).tobytes() + u[o][at].astype(np.uint32).tobytes() + n.astype(np.uint32).tobytes() + v[o].astype(np.uint32).tobytes() + _narrow(c[o]).tobytes()  # noqa: B023

            yield _dealt(_pair_bucket(m, u, v), blob, m.buckets)

    return run


def _store_pairs(m: Model):
    """Saves each bucket's pairs; yields a task's sums for the words' buckets: kind 0: contexts (id, n1, n2, n3), 1: words (id, distinct contexts), 2: counts of counts, 3: the begin mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_counts, begin = np.zeros(4, np.int64), np.zeros(3, np.int64)
        sums: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for k, blobs in C.by_bucket(batches):
            keys, counts = [], []
            for x in blobs:
                nu, n = map(int, np.frombuffer(x, np.int64, 2))
                u, each, v = np.split(np.frombuffer(x, np.uint32, 2 * nu + n, 16), [nu, 2 * nu])
                c = _wide(np.frombuffer(x, np.uint8, offset=16 + 4 * (2 * nu + n)), n)
                keys.append((np.repeat(u, each).astype(U) << U(32)) | v.astype(U))
                counts.append(c.astype(np.int64))
            key, c = _summed(keys, counts)
            h = mix(key)
            order = np.argsort(h)
            hashstore.save(m.uri, f"pairs-{k}", h[order])
            hashstore.save(m.uri, f"pair_counts-{k}", _narrow(c[order]))
            u, v = (key >> U(32)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.int64)
            of_counts += np.bincount(np.minimum(c, 5), minlength=6)[1:5]
            at = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            stats = np.stack([u[at]] + [np.add.reduceat((c == 1 if i == 1 else c == 2 if i == 2 else c >= 3).astype(np.int64), at) for i in (1, 2, 3)], 1)
            first = stats[:, 0] == BEGIN
            begin += stats[first][:, 1:].sum(0)
            words, n = np.unique(v, return_counts=True)
            sums[0].append(stats[~first])
            sums[1].append(np.stack([words, n], 1))
        kinds, owners, out = [2, 3], [-1, -1], [of_counts.tobytes(), begin.tobytes()]
        for kind in (0, 1):
            # one sum for each word of all the task's buckets
            rows = np.concatenate(sums[kind]) if sums[kind] else np.zeros((0, 4 - 2 * kind), np.int64)
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            at = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) if len(rows) else np.zeros(0, np.int64)
            if len(rows):
                rows = np.concatenate([rows[at, :1], np.add.reduceat(rows[:, 1:], at, axis=0)], 1)
            cut = np.searchsorted(rows[:, 0], m.first)
            for j in range(m.buckets):
                if cut[j + 1] > cut[j]:
                    kinds.append(kind)
                    owners.append(j)
                    out.append(rows[cut[j] : cut[j + 1]].astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(owners, pa.int32()), pa.array(out, pa.binary())], ["kind", "bucket", "blob"])

    return run


def _store_sums(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed():
            for b in batches:
                kind = C.column(b, "kind").to_pylist()
                yield pa.RecordBatch.from_arrays([C.column(b, "bucket"), pa.array([bytes([k]) + x for k, x in zip(kind, C.column(b, "blob").to_pylist(), strict=True)], pa.binary())], ["bucket", "blob"])

        for k, blobs in C.by_bucket(packed()):
            n = int(m.first[k + 1] - m.first[k])
            followers, contexts = np.zeros((n, 3), np.uint32), np.zeros(n, np.uint32)
            for x in blobs:
                if x[0]:
                    r = np.frombuffer(x, np.uint32, offset=1).reshape(-1, 2)
                    contexts[r[:, 0] - np.uint32(m.first[k])] += r[:, 1]
                else:
                    r = np.frombuffer(x, np.uint32, offset=1).reshape(-1, 4)
                    followers[r[:, 0] - np.uint32(m.first[k])] += r[:, 1:]
            for i in range(3):
                hashstore.save(m.uri, f"n{i + 1}-{k}", followers[:, i])
            hashstore.save(m.uri, f"contexts-{k}", contexts)
            of = np.bincount(np.minimum(contexts, 5), minlength=6)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([int(contexts.sum(dtype=np.int64))], pa.int64()), *(pa.array([int(of[i])], pa.int64()) for i in range(1, 5)), pa.array([int((contexts >= 3).sum())], pa.int64())], ["bucket", "total", "c1", "c2", "c3", "c4", "over"])

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified discounts [0, D1, D2, D3+] of counts of counts n1..n4; 0.5, 1, 1.5 where those are too few to tell."""
    n1, n2, n3, n4 = map(float, n)
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.where((d[1:] > 0) & (d[1:] < [1, 2, 3]), d[1:], [0.5, 1.0, 1.5])[[0, 0, 1, 2]] * [0, 1, 1, 1]


def train(docs: DataFrame) -> Model:
    """A model of all texts of docs."""
    spark = docs.sparkSession
    C.arrow_limits(spark)
    texts = docs.select(C.text_bytes())
    parts = C.partitions_for(spark)
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = 1 << max(6, (parts - 1).bit_length(), (size // BUCKET_BYTES).bit_length())
    uri = f"{C.shared_dir(spark)}/bigrams-{uuid.uuid4().hex}"

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket")

    words = dealt(texts.mapInArrow(_count_words(buckets), "bucket int, blob binary")).mapInArrow(_store_words(uri), "bucket int, words long, tokens long").collect()  # a row a bucket
    sizes = np.zeros(buckets, np.int64)
    for r in words:
        sizes[r.bucket] = r.words
    m = Model(uri, buckets, np.concatenate([[0], np.cumsum(sizes)]), sum(r.tokens for r in words))
    if not m.words:
        return m
    if m.words >= BEGIN:
        raise ValueError("more words than 32-bit numbers")
    some = spark.range(buckets).where(F.col("id").isin([r.bucket for r in words])).select(F.col("id").cast("int").alias("bucket"))
    m.hot = np.array([BEGIN] + [r.id for r in some.mapInArrow(_hot(uri, [], m.first, max(1, -(-m.tokens // HOT))), "id long").collect()], np.int64)  # HOT at most
    known = spark.sparkContext.broadcast(m)
    pairs = dealt(texts.mapInArrow(lambda it: _count_pairs(known.value)(it), "bucket int, blob binary"))
    sums = C.written(pairs.mapInArrow(lambda it: _store_pairs(known.value)(it), "kind int, bucket int, blob binary"), "bigram-sums")
    of_counts, begin = np.zeros(4, np.int64), np.zeros(3, np.int64)
    for kind, blob in sums.where("kind >= 2").select("kind", "blob").collect():  # two short rows a task
        if kind == 2:
            of_counts += np.frombuffer(blob, np.int64)
        else:
            begin += np.frombuffer(blob, np.int64)
    per_word = dealt(sums.where("kind < 2")).mapInArrow(lambda it: _store_sums(known.value)(it), "bucket int, total long, c1 long, c2 long, c3 long, c4 long, over long").collect()  # a row a bucket
    c = np.array([[r.c1, r.c2, r.c3, r.c4, r.over, r.total] for r in per_word], np.int64).sum(0)
    m.discounts = np.stack([discounts(c[:4]), discounts(of_counts)])
    m.contexts = int(c[5])
    m.words_over = float(m.discounts[0] @ [0, c[0], c[1], c[4]]) / m.contexts
    m.begin = np.concatenate([[rows], begin]).astype(float)
    return m


def _lookup_pairs(m: Model, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Counts of distinct pairs of known words."""
    out = np.zeros(len(word), np.int64)
    h = mix((context.astype(U) << U(32)) | word.astype(U))
    bucket = _pair_bucket(m, context, word)
    order = np.lexsort((h, bucket))
    cut = np.searchsorted(bucket[order], np.arange(m.buckets + 1))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        o = order[cut[k] : cut[k + 1]]
        try:
            known = hashstore.load(m.uri, f"pairs-{k}", U)
        except FileNotFoundError:  # no pair of training fell into this bucket
            continue
        at = np.minimum(np.searchsorted(known, h[o]), len(known) - 1)
        counts = _wide(hashstore.load(m.uri, f"pair_counts-{k}", np.uint8), len(known))
        out[o] = np.where(known[at] == h[o], counts[at], 0)
    return out


def _score(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.text_blocks(batches):
            number, at, word, context, doc = _pairs(m, b)
            rows = b.num_rows
            seen = np.flatnonzero(number >= 0)  # names are sorted, so are their numbers
            count, low = np.zeros(len(number)), np.full(len(number), 1.0 / (m.words + 1))
            total, left = np.zeros(len(number)), np.ones(len(number))
            if m.words:
                ids = number[seen]
                count[seen] = _gather(m, ids, "counts", np.int64)
                n = _gather(m, ids, "contexts", np.uint32).astype(float)
                low *= m.words_over
                low[seen] += np.maximum(0, n - m.discounts[0][np.minimum(n, 3).astype(int)]) / m.contexts
                total = count
                d = m.discounts[1]
                over = sum(d[i] * _gather(m, ids, f"n{i}", np.uint32) for i in (1, 2, 3))
                followed = _gather(m, ids, "n1", np.uint32).astype(np.int64) + _gather(m, ids, "n2", np.uint32) + _gather(m, ids, "n3", np.uint32)
                left[seen] = np.where(followed > 0, over / count[seen], 1.0)  # the end token is no context
            p = low[at]
            if m.words:
                begins = context == BEGIN
                before = np.empty(len(at), np.int64)
                before[1:] = at[:-1]
                before[begins] = 0
                gamma = np.where(begins, float(m.discounts[1][1:] @ m.begin[1:]) / m.begin[0], left[before])
                of = np.where(begins, m.begin[0], np.where(context >= 0, total[before], 1))
                both = np.flatnonzero((word >= 0) & (context >= 0))
                key, back = np.unique((context[both].astype(U) << U(32)) | word[both].astype(U), return_inverse=True)
                c = _lookup_pairs(m, (key >> U(32)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.int64))[back].astype(float)
                p = p * gamma
                p[both] += np.maximum(0, c - m.discounts[1][np.minimum(c, 3).astype(int)]) / np.maximum(1, of[both])
            sums = lambda x: np.bincount(doc, weights=x, minlength=rows)
            c = count[at]
            yield pa.RecordBatch.from_arrays(
                [C.column(b, "doc_id"), C.column(b, "held_out"), pa.array(np.bincount(doc, minlength=rows)), pa.array(sums(c > 0).astype(np.int64)), pa.array(np.full(rows, m.tokens)), pa.array(sums(np.log10((c + 0.1) / (m.tokens + 0.1 * (m.words + 1))))), pa.array(sums(np.log10(p)))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row of docs (doc_id, text)."""
    C.arrow_limits(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select("doc_id", held_out().alias("held_out"), C.text_bytes())
    out = source.mapInArrow(lambda it: _score(known.value)(it), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
