"""Groups of spelling variants: words of a corpus that differ by one code point, found by a trie of letter-group counts.

A word is a run of letters (RUN), A-Z in lower case, of at least SHORTEST code points that occurs at least COMMON times. Letters are dealt to GROUPS
groups of nearly equal use. One inserted code point adds one to the length and one to a group; one replaced adds one to a group and takes one from
another, or stays within a group. So words stand in a trie by length, then by the count of each group, and a word's search goes down it depth first, a
block of words at a time, with a surplus of one and a deficit of one to spend. It visits only words that come after its own (by length, then counts,
where the first difference must be a surplus), so each pair is met once. What stands in the leaves is verified letter by letter.

The trie is dealt to tasks by its first levels (length, two counts). The number of words under each such prefix is collected (KEYS numbers at most, a constant);
prefixes are packed into parts of PART words, and a prefix of more is split by a hash of the word into several parts. A word is sent to the one part that
holds it, and as a question to the few parts that its budget reaches; questions stream past a part's trie. Nothing is capped or left out.

Defined results: null and empty texts have no words; a null doc_id reads as an empty one in the hash that damages runs; repeated rows count as often as
they occur; ties between forms go to the smaller word in code-point order; other columns are ignored; without words there are no rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RUN = re.compile("[A-Za-zÀ-ÿ]{6,}")
SHORTEST, COMMON = 6, 5
#: A run whose hash this divides loses one code point (a stated share of misspellings).
DAMAGE = 199
#: A form is this many times as frequent as its variant.
RATIO = 5
GROUPS = 14
#: Words of one part, and of one block of questions.
PART, BLOCK = 16384, 4096
#: Pairs that are verified at once, and the longest word whose letters stand in arrays; longer ones are compared one by one.
PAIRS, WIDE = 1 << 19, 48
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000
_LENGTHS, _COUNTS = 64, 16
KEYS = _LENGTHS * _COUNTS * _COUNTS
_LOWER = {k: k + 32 for k in range(65, 91)}


def runs_of(doc_id: int | None, text: str, into: Counter) -> None:
    """Adds the damaged lower-cased runs of one text (of SHORTEST code points and more)."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lower: Counter = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        lower[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    for run, n in lower.items():
        h = zlib.crc32(run.encode(), start)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        into[run] += n


def words(docs: DataFrame) -> DataFrame:
    """word, n of the words of docs (doc_id, text) that occur at least COMMON times."""
    C.arrow_limits(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for d, t in zip(C.column(b, "doc_id").to_pylist(), C.column(b, "text").to_pylist(), strict=True):
                runs_of(d, t, held)
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    source = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)


# --- counts of letter groups ----------------------------------------------------------------------------------------------------------------------


def letters(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all words in a row, lengths): a letter is one Latin-1 byte."""
    return np.frombuffer("".join(some).encode("latin-1"), np.uint8), np.fromiter(map(len, some), np.int64, len(some))


def dealt(uses: np.ndarray) -> np.ndarray:
    """Group of each letter: the most used letter first, to the group of least use so far."""
    group, load = np.zeros(256, np.int64), np.zeros(GROUPS)
    for k in np.argsort(-uses, kind="stable"):
        group[k] = np.argmin(load)
        load[group[k]] += uses[k] + 1e-9
    return group


def vectors(some: list[str], group: np.ndarray) -> np.ndarray:
    """Length, then the count of each group, of each word."""
    data, size = letters(some)
    row = np.repeat(np.arange(len(some)), size)
    counts = np.bincount(row * GROUPS + group[data], minlength=len(some) * GROUPS).reshape(len(some), GROUPS)
    return np.concatenate([size[:, None], counts], 1)


def prefix_key(length: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (np.minimum(length, _LENGTHS - 1) * _COUNTS + np.minimum(first, _COUNTS - 1)) * _COUNTS + np.minimum(second, _COUNTS - 1)


#: What the budget makes of (length, first count, second count) of words that come after: as many letters, then one more.
REACH = ((0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, -1), (1, 0, 0), (1, 1, 0), (1, 0, 1))


class Parts:
    """Where words of a prefix are: part `first` of each key, and the following ones if it is split."""

    def __init__(self, sizes: np.ndarray):
        self.first, self.split = np.zeros(KEYS, np.int64), np.zeros(KEYS, np.int64)
        part, load = 0, 0
        for k in np.flatnonzero(sizes):
            n = int(sizes[k])
            if load and load + n > PART:
                part, load = part + 1, 0
            self.first[k], self.split[k] = part, max(1, -(-n // PART))
            load += n
            if n > PART:
                part, load = part + int(self.split[k]), 0
        self.count = part + 1

    def home(self, key: np.ndarray, some: list[str]) -> np.ndarray:
        out = self.first[key]
        for i in np.flatnonzero(self.split[key] > 1):
            out[i] += zlib.crc32(some[i].encode()) % self.split[key[i]]
        return out

    def asked(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) of all parts that the rows' budget reaches, each once."""
        found = []
        for d, a, b in REACH:
            ok = v[:, 2] + b >= 0
            key = prefix_key(v[:, 0] + d, v[:, 1] + a, np.maximum(v[:, 2] + b, 0))
            n = np.where(ok, self.split[key], 0)
            row = np.repeat(np.arange(len(v)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            found.append(row * self.count + self.first[key[row]] + nth)
        both = np.unique(np.concatenate(found))
        return both // self.count, both % self.count


# --- the trie -------------------------------------------------------------------------------------------------------------------------------------


class Trie:
    """Sorted vectors; of each level the sorted (parent node, value) of its nodes."""

    def __init__(self, v: np.ndarray):
        self.rows = np.lexsort(v.T[::-1])
        v = v[self.rows]
        self.base = int(v.max(initial=0)) + 3
        node, self.levels = np.zeros(len(v), np.int64), []
        for k in range(v.shape[1]):
            key = node * self.base + v[:, k]
            new = np.ones(len(v), bool)
            new[1:] = key[1:] != key[:-1]
            self.levels.append(key[new])
            node = np.cumsum(new) - 1
        self.start = np.append(np.flatnonzero(new), len(v)) if len(v) else np.zeros(1, np.int64)

    def _down(self, k: int, node: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which have such a child, the child) on level k."""
        keys = self.levels[k]
        want = node * self.base + value
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = (keys[at] == want) & (value >= 0) & (value < self.base)
        return hit, at

    def search(self, v: np.ndarray, longer: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of v, row of the trie) of all pairs within the budget. longer 1: trie words have one letter more (a surplus of one); 0: as many (a surplus of one,
        then a deficit of one, or neither)."""
        if not len(self.rows) or not len(v):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q = np.arange(len(v))
        hit, node = self._down(0, np.zeros(len(v), np.int64), v[:, 0] + longer)
        q, node = q[hit], node[hit]
        spent = np.zeros(len(q), np.int8)  # 1: the surplus, 2: the deficit too
        for k in range(1, v.shape[1]):
            parts = []
            for delta, may in ((0, None), (1, spent == 0), (-1, spent == 1)):
                if delta < 0 and longer:
                    continue
                at = slice(None) if may is None else np.flatnonzero(may)
                hit, child = self._down(k, node[at], v[q[at], k] + delta)
                parts.append((q[at][hit], child[hit], spent[at][hit] + np.int8(delta != 0)))
            q, node, spent = (np.concatenate(x) for x in zip(*parts, strict=True))
        good = spent == 1 if longer else spent != 1
        q, node = q[good], node[good]
        n = self.start[node + 1] - self.start[node]
        row = np.repeat(self.start[node] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.repeat(q, n), self.rows[row]


def one_apart(a: str, b: str) -> bool:
    """Whether b is a with one code point replaced, or inserted."""
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


class Letters:
    """Words as rows of letters, from the left and from the right; those of over WIDE letters are left empty."""

    def __init__(self, some: list[str]):
        self.words = some
        data, size = letters(some)
        self.size = size
        first = np.cumsum(size) - size
        width = min(WIDE, int(size.max(initial=0))) + 1
        col = np.arange(width)
        short = (size <= WIDE)[:, None]
        data = np.append(data, np.uint8(0))
        self.left = np.where(short & (col < size[:, None]), data[np.minimum(first[:, None] + col, len(data) - 1)], 0).astype(np.uint8)
        self.right = np.where(short & (col < size[:, None]), data[np.clip((first + size - 1)[:, None] - col, 0, len(data) - 1)], 0).astype(np.uint8)

    def near(self, other: Letters, a: np.ndarray, b: np.ndarray, longer: int) -> np.ndarray:
        """Which pairs (a of self, b of other) are one apart; words of other have `longer` letters more."""
        ok = np.zeros(len(a), bool)
        for i in range(0, len(a), PAIRS):
            x, y = a[i : i + PAIRS], b[i : i + PAIRS]
            w = min(self.left.shape[1], other.left.shape[1])
            if longer:
                differ = lambda p, q: np.argmax(p[x, :w] != q[y, :w], axis=1)
                ok[i : i + PAIRS] = differ(self.left, other.left) + differ(self.right, other.right) >= self.size[x]
            else:
                ok[i : i + PAIRS] = np.count_nonzero(self.left[x, :w] != other.left[y, :w], axis=1) == 1
        for i in np.flatnonzero((self.size[a] >= WIDE) | (other.size[b] > WIDE)):
            ok[i] = one_apart(self.words[a[i]], other.words[b[i]])
        return ok


class Best:
    """Of each word: how many are near it, and the first of them by count, then word."""

    def __init__(self, some: list[str], n: np.ndarray):
        self.words, self.n = some, n
        self.near, self.first = [0] * len(some), [None] * len(some)

    def add(self, at: list[int], other: Best, of: list[int]) -> None:
        n, name = other.n, other.words
        for a, b in zip(at, of, strict=True):
            self.near[a] += 1
            one = (-n[b], name[b])
            if self.first[a] is None or one < self.first[a]:
                self.first[a] = one

    def batch(self) -> pa.RecordBatch:
        at = [i for i, k in enumerate(self.near) if k]
        cols = [[self.words[i] for i in at], [self.near[i] for i in at], [-self.first[i][0] for i in at], [self.first[i][1] for i in at]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "form_n", "form"])


def _solved(batches: Iterator[pa.RecordBatch], group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows part, asks, word, n, sorted by part, words of the part before questions -> word, n_near, form_n, form of each that has a near one."""
    part, trie, stored, asked = None, None, ([], []), ([], [])

    def built() -> tuple:
        return Trie(vectors(stored[0], group)), Letters(stored[0]), Best(*stored)

    def answers() -> Iterator[pa.RecordBatch]:
        tree, own, best = trie
        order = sorted(range(len(asked[0])), key=lambda i: len(asked[0][i]))  # words of about one length stand together
        some, n = [asked[0][i] for i in order], [asked[1][i] for i in order]
        v, them, of = vectors(some, group), Letters(some), Best(some, n)
        for longer in (0, 1):
            a, b = tree.search(v, longer)
            if not longer:  # equal vectors: each pair once, by the word
                same = (v[a] == tree_v[b]).all(1)
                keep = ~same | np.fromiter((not s or some[x] < stored[0][y] for s, x, y in zip(same.tolist(), a.tolist(), b.tolist(), strict=True)), bool, len(a))
                a, b = a[keep], b[keep]
            ok = them.near(own, a, b, longer)
            a, b = a[ok].tolist(), b[ok].tolist()
            of.add(a, best, b)
            best.add(b, of, a)
        yield of.batch()

    tree_v = None
    for batch in batches:
        for p, asks, word, n in zip(*(C.column(batch, k).to_pylist() for k in ("part", "asks", "word", "n")), strict=True):
            if p != part or (asks and len(asked[0]) >= BLOCK):
                if trie is None and part is not None:
                    trie, tree_v = built(), vectors(stored[0], group)
                if asked[0]:
                    yield from answers()
                    asked = ([], [])
                if p != part:
                    if part is not None:
                        yield trie[2].batch()
                    part, trie, stored = p, None, ([], [])
            if asks:
                asked[0].append(word)
                asked[1].append(n)
            else:
                stored[0].append(word)
                stored[1].append(n)
    if part is not None:
        trie, tree_v = trie or built(), vectors(stored[0], group)
        if asked[0]:
            yield from answers()
        yield trie[2].batch()


# --- on Spark -------------------------------------------------------------------------------------------------------------------------------------


def _histogram(some: DataFrame, size: int, of) -> np.ndarray:
    """Sums over all tasks of the bincounts of(words); collects a row for each task of `size` numbers at most, as (place, number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, np.int64)
        for b in batches:
            out += np.bincount(of(C.column(b, "word").to_pylist()), minlength=size)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["at", "k"])

    out = np.zeros(size, np.int64)
    for at, k in some.select("word").mapInArrow(run, "at long, k long").groupBy("at").agg(F.sum("k")).collect():
        out[at] = k
    return out


def near_words(some: DataFrame) -> DataFrame:
    """word, n_near, form_n, form of each of some (word, n; distinct words) that has near words; form: the most frequent of them."""
    group = dealt(_histogram(some, 256, lambda w: letters(w)[0]))

    def keys(w: list[str]) -> np.ndarray:
        v = vectors(w, group)
        return prefix_key(v[:, 0], v[:, 1], v[:, 2])

    parts = Parts(_histogram(some, KEYS, keys))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, n = C.column(b, "word").to_pylist(), C.column(b, "n")
            v = vectors(w, group)
            row, part = parts.asked(v)
            row = np.concatenate([np.arange(len(w)), row])
            part = np.concatenate([parts.home(prefix_key(v[:, 0], v[:, 1], v[:, 2]), w), part])
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.arange(len(row)) >= len(w)), C.column(b, "word").take(pa.array(row)), n.take(pa.array(row))], ["part", "asks", "word", "n"])

    placed = some.select("word", "n").mapInArrow(sent, "part long, asks boolean, word string, n long")
    solved = placed.repartition(max(parts.count, 1), "part").sortWithinPartitions("part", "asks").mapInArrow(lambda x: _solved(x, group), "word string, n_near long, form_n long, form string")
    first = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return solved.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.less")).alias("form_n"), "first.form")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of each of forms (word, form): forms are followed to the last by joins that double the distance each time. A form is RATIO times as frequent as its
    word, so chains are short and have no loops."""
    now = C.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = C.written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        C.dropped(now)
        if step.where("moved").isEmpty():
            return step.drop("moved")
        now = step.select("word", "root")
        now._written = step._written


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of docs (doc_id, text)."""
    some = C.written(words(docs), "words")
    near = C.written(near_words(some), "near")
    joined = some.join(near, "word", "left").withColumn("good", F.col("form_n") >= RATIO * F.col("n"))
    each = C.written(joined.select("word", F.when(F.col("good"), F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("good"), F.col("form_n")).alias("form_n")), "forms")
    C.dropped(some, near)
    last = roots(each.where("form is not null"))
    return each.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
