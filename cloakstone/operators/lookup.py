"""Looking learned values up in texts by keyed hashes: the index holds no value, so it can be kept from run to run.

A text's pieces are its runs of letters and digits (in lower case, without accents; each with a keyed hash). A value is a window of pieces: `grain_7x`
is two, and stands as such in `fin.grain_7x`, `grain_7x/part-0` or `s3://grain_7x`. All windows of a text of as many pieces as some value has are hashed by one
pass over prefix sums, whatever their number; a value of more than WIDE pieces is met by its first WIDE. Numbers of LONG_NUMBER digits and more have a second
window of their digits alone, so other punctuation or blanks don't hide them.

A broadcast bit filter, sized by the number of windows (at most MOST_BITS), lets few windows through; those join the index by their hash. Then the place is cut out
with the signs that the value had around its pieces, and is the value only if the keyed id of its canonical form is the index's, and if it stands whole
(`grain_7xy`, `my-grain_7x` and `grain_7x_old` are other names). Values without a letter or digit aren't looked up."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T

U = np.uint64
WIDE = 16
#: In place of a number of pieces: a window of WIDE pieces of a longer value, and one of digits alone.
LONGER, DIGITS = WIDE + 1, 0
LONG_NUMBER = 8
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 16, 1 << 29, 16
#: Hashes of pieces that a worker keeps.
KEPT = 200_000
INDEX = "id string, type string, scope string, window long, pieces int, lead int, trail int, size int"
CANDIDATE = "start int, end int, window long, pieces int, left string, body string, right string"
_PIECE = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"[0-9](?:[0-9.\-/ ()]*[0-9xX])?")
_DIGITS = re.compile(r"[0-9]+")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    return x ^ (x >> U(33))


class Hasher:
    """Keyed hashes of pieces and of windows."""

    def __init__(self, secret: bytes):
        self.secret, self._kept = secret, {}
        self._up, self._down = np.ones(1, U), np.ones(1, U)

    def piece(self, raw: str) -> int:
        h = self._kept.get(raw)
        if h is None:
            if len(self._kept) > KEPT:
                self._kept.clear()
            plain = "".join(c for c in unicodedata.normalize("NFD", raw.lower()) if unicodedata.category(c) != "Mn")
            h = self._kept[raw] = int.from_bytes(hmac.new(self.secret, b"piece\0" + plain.encode("utf-8", "surrogatepass"), hashlib.sha256).digest()[:8])
        return h

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = max(n, 1024)
            self._up = np.cumprod(np.concatenate([[U(1)], np.full(n, _BASE, U)]), dtype=U)
            self._down = np.cumprod(np.concatenate([[U(1)], np.full(n, _INVERSE, U)]), dtype=U)
        return self._up, self._down

    def windows(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Of each place, the hash of k pieces from there on (k: LONGER for the first WIDE of more)."""
        n = WIDE if k == LONGER else k
        up, down = self._powers(len(hashes) + 1)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(hashes * up[: len(hashes)], dtype=U)])
        return (sums[n:] - sums[:-n]) * down[: max(0, len(hashes) - n + 1)]

    def closed(self, windows: np.ndarray, k: int) -> np.ndarray:
        return _mixed(windows + U((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))

    def digits(self, canonical: str) -> int:
        return int(self.closed(np.array([self.piece("n" + canonical)], U), DIGITS)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def indexed(values: DataFrame, key: ids.Key) -> DataFrame:
    """INDEX of values (type, real, scope: where alone they apply, or null)."""
    secret = key.secret
    real = F.when(F.col("type").startswith("obj."), ids.unquoted(F.col("real"))).otherwise(F.col("real"))
    ready = values.select(key.id(F.lit("visto"), ids.canonical_key(F.col("type"), F.col("real"))).alias("id"), "type", F.col("scope").cast("string").alias("scope"), real.alias("real"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, names = Hasher(secret), [x.split()[0] for x in INDEX.split(", ")]
        kinds = [pa.string()] * 3 + [pa.int64()] + [pa.int32()] * 4
        for b in batches:
            rows = []
            for r in b.to_pylist():
                at = [(m.start(), m.end()) for m in _PIECE.finditer(r["real"] or "")]
                head = (r["id"], r["type"], r["scope"])
                if at:
                    k = min(len(at), LONGER)
                    w = hasher.windows(np.array([hasher.piece(r["real"][a:z]) for a, z in at], U), k)[0]
                    rows.append((*head, signed(int(hasher.closed(np.array([w]), k)[0])), k, at[0][0], 0 if k == LONGER else len(r["real"]) - at[-1][1], len(r["real"])))
                number = "".join(_DIGITS.findall(r["real"] or "")) + ("x" if (r["real"] or "")[-1:] in ("x", "X") else "")
                if r["type"] in ids.NUMERIC and len(number) >= LONG_NUMBER:
                    rows.append((*head, signed(hasher.digits(number)), DIGITS, 0, 0, len(number)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)

    return ready.mapInArrow(run, INDEX)


@dataclass
class Filter:
    """What a worker must know of an index: its bits, numbers of pieces, lengths of numbers, signs around values."""

    bits: np.ndarray
    pieces: list[int]
    numbers: set[int]
    lead: int
    trail: int
    size: int

    def holds(self, windows: np.ndarray) -> np.ndarray:
        at = windows & U(len(self.bits) * 64 - 1)
        return (self.bits[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1


def bits_of(index: DataFrame, n: int) -> np.ndarray:
    """The bit filter of n windows. It grows with them up to MOST_BITS (64 MB); beyond, more windows pass that the join drops."""
    size = LEAST_BITS
    while size < min(MOST_BITS, BITS_EACH * n):
        size *= 2
    place = F.col("window").bitwiseAND(F.lit(size - 1))
    words = index.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, U)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(U)
    return out


def filter_of(index: DataFrame) -> Filter:
    long, number = F.col("pieces") == LONGER, F.col("pieces") == DIGITS
    r = index.agg(F.count("*").alias("n"), F.collect_set("pieces").alias("pieces"), F.collect_set(F.when(number, F.col("size"))).alias("numbers"), F.max("lead").alias("lead"), F.max("trail").alias("trail"), F.max(F.when(long, F.col("size"))).alias("size")).first()
    return Filter(bits_of(index, r.n), sorted(k for k in r.pieces if k), set(r.numbers), r.lead or 0, r.trail or 0, r["size"] or 0)


def candidates(text: str, f: Filter, hasher: Hasher) -> list[tuple]:
    """CANDIDATE of the windows that the filter lets through, with the text around them that a value may hold."""
    at = [m.span() for m in _PIECE.finditer(text)]
    out: list[tuple] = []

    def found(a: int, z: int, w: int, k: int, left: str) -> None:
        end = min(len(text), a + f.size + 2) if k == LONGER else z
        out.append((a, z, signed(w), k, left, text[a:end], text[z : z + f.trail + 2]))

    if at and f.pieces:
        hashes = np.array([hasher.piece(text[a:z]) for a, z in at], U)
        # the first letter may belong to an escape: \ngrain_7x
        escaped = [i for i, (a, z) in enumerate(at) if a and text[a - 1] == "\\" and text[a] in "ntr" and z - a > 1 and text[a - 2 : a - 1] != "\\"] if "\\" in text else []
        for k in f.pieces:
            if len(at) < (WIDE if k == LONGER else k):
                continue
            open_ = hasher.windows(hashes, k)
            closed = hasher.closed(open_, k)
            last = (WIDE if k == LONGER else k) - 1
            for i in np.flatnonzero(f.holds(closed)).tolist():
                a, z = at[i][0], at[i + last][1]
                found(a, z, int(closed[i]), k, text[max(0, a - f.lead - 1) : a])
            for i in escaped:
                if i < len(open_):
                    a, z = at[i]
                    w = hasher.closed(open_[i : i + 1] - hashes[i : i + 1] + np.array([hasher.piece(text[a + 1 : z])], U), k)
                    if f.holds(w)[0]:
                        found(a + 1, at[i + last][1], int(w[0]), k, "")
    for m in _NUMBER.finditer(text) if f.numbers else ():
        if sum(c.isdigit() for c in m[0]) < LONG_NUMBER:
            continue
        parts, most = [(m.start() + p.start(), m.start() + p.end(), p[0]) for p in _DIGITS.finditer(m[0])], max(f.numbers)
        for i, (a, _, _) in enumerate(parts):
            digits = ""
            for _, z, d in parts[i:]:
                digits += d
                if len(digits) > most:
                    break
                for number, end in ((digits, z), (digits + "x", z + 1)) if text[z : z + 1] in ("x", "X") and z < m.end() else ((digits, z),):
                    if len(number) in f.numbers and f.holds(np.array([w := hasher.digits(number)], U))[0]:
                        found(a, end, w, DIGITS, text[max(0, a - f.lead - 2) : a])
    return out


def verified(found: DataFrame, index: DataFrame, key: ids.Key) -> DataFrame:
    """found (rows of CANDIDATE, _scope and others) that are values of the index: its other columns, id, type, scope, start, end, real.

    A candidate meets the values of all texts and those of its own scope: the scope is a key of the join, so a name that many scopes have isn't held against each of them."""
    c = F.col
    of = lambda scope: F.coalesce(F.concat(F.lit("s"), scope), F.lit(""))
    each = found.withColumn("_of", F.explode(F.array_distinct(F.array(F.lit(""), of(c("_scope"))))))
    joined = each.join(index.withColumnRenamed("pieces", "_pieces").withColumn("_of", of(c("scope"))), ["window", "_of"]).drop("_of").where((c("pieces") == c("_pieces")) & (F.length("left") >= c("lead")))
    before = F.substr(c("left"), F.length("left") - c("lead") + 1)
    long = c("pieces") == LONGER
    real = F.when(long, F.concat(before, F.substr(c("body"), F.lit(1), c("size") - c("lead")))).otherwise(F.concat(before, c("body"), F.substr(c("right"), F.lit(1), c("trail"))))
    after = F.when(long, F.substr(c("body"), c("size") - c("lead") + 1)).otherwise(F.substr(c("right"), c("trail") + 1))
    seen = joined.withColumn("real", real).withColumn("_after", after).withColumn("_before", F.substr(c("left"), F.lit(1), F.length("left") - c("lead")))
    letter = r"[\p{L}\p{N}]"
    whole = ~(c("real").rlike("^" + letter) & c("_before").rlike(letter + "$")) & ~(c("real").rlike(letter + "$") & c("_after").rlike("^" + letter))
    name = ~c("_before").rlike(r"[\p{L}\p{N}_$#\-]$") & ~c("_after").rlike(r"^(?:[\p{L}\p{N}_$#]|-[\p{L}\p{N}_$#])")
    number = ~c("_before").rlike(r"[0-9][.\-/]$") & ~c("_after").rlike(r"^[.\-/][0-9]")
    good = whole & F.when(c("type").startswith("obj."), name).when(c("pieces") == DIGITS, number).otherwise(F.lit(True))
    same = key.id(F.lit("visto"), ids.canonical_key(c("type"), c("real"))) == c("id")
    out = seen.where(good & same).withColumn("start", (c("start") - c("lead")).cast("int")).withColumn("end", (c("start") + F.length("real")).cast("int"))
    return out.drop("_pieces", "_after", "_before", "lead", "trail", "size", "left", "body", "right", "pieces", "window")


def valid(index: DataFrame, today: int, days: int) -> DataFrame:
    """The rows of a kept index (with seen_day: days since the epoch) that were seen within the last days."""
    return index.where(F.col("seen_day") >= today - days)


def merged(kept: DataFrame | None, new: DataFrame, today: int) -> DataFrame:
    """A kept index and a run's own as one: earliest learned_day, latest seen_day; of one id and scope, one type (the kept one's, then the least)."""
    rows = new.select(*[x.split()[0] for x in INDEX.split(", ")], F.lit(today).alias("learned_day"), F.lit(today).alias("seen_day"), F.lit(1).alias("_new"))
    if kept is not None:
        rows = rows.unionByName(kept.withColumn("_new", F.lit(0)))
    first = lambda n: F.min_by(n, F.struct("_new", "type")).alias(n)
    return rows.groupBy("id", "scope", "window", "pieces").agg(first("type"), first("lead"), first("trail"), first("size"), F.min("learned_day").alias("learned_day"), F.max("seen_day").alias("seen_day"))
