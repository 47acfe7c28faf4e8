"""One mask of all parts over a corpus: detect and read each text, learn from all texts, look the learned values up in all texts, resolve once, mask.

A run learns from everything first and applies to everything then, so the order of arrival doesn't matter. A value learned in one text is masked
wherever it stands whole (lookup.py: within qualified names, paths and addresses, of any length, with any signs and accents): values and names with evidence
(known.known_values) in all texts, other names within their scope (a conversation, a source), people by a registry of hashes.

An index of an earlier run (`seen`, written to `remember`) holds keyed hashes and no value. What it learned is masked in this run too, if it was seen within `days`.

With `origin`, a name that others than the data wrote first in a scope (a model, a page of the web) spreads nowhere from there, and isn't masked there by its spelling
alone: who wrote it is the first mention of the name in the scope's order, over all its texts.

Only texts with a window that the filter lets through are shuffled. Texts are written twice (with findings, with candidates) and never collected."""

from __future__ import annotations

import base64
import hashlib
import hmac
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions import ids
from ..functions import text as T
from ..plans.config import Config
from ..readers.stage import DEFAULT, with_names
from ..sources.tables import dropped, written
from . import intervals, known, lookup, mask
from .detect import detect, exploded

#: Characters of a value that is learned.
SHORTEST = 4
#: Bits of the filter of registered people (2 MB).
BITS = 1 << 24
_CODE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_.\-@/+]*[A-Za-z0-9])?")
_NAME_WORD = re.compile(r"[^\W\d_][^\W\d_'’\-]*(?:['’\-][^\W\d_]+)*")
#: Words of a registered name, where the registry doesn't say.
NAME_WORDS = (2, 3, 4, 5, 6)


def learn(each: DataFrame, scope: str | None, *order: str, words: bool = False) -> DataFrame:
    """type, real, scope of the values that findings teach: everywhere (scope null), and names of a scope within it (by the first decision there; words: also those
    that are plain words)."""
    everywhere = known.known_values(each, *order).select("type", "real", F.lit(None).cast("string").alias("scope"))
    if scope is None:
        return everywhere
    named = each.where(F.col("type").startswith("obj.") & (F.length("real") >= SHORTEST) & (F.lit(words) | known.identifier_shape(F.col("real"))) & F.col(scope).isNotNull())
    first = lambda c: F.min_by(c, F.struct(*order, "start", "type")).alias(c)
    key = ids.canonical_key(F.col("type"), F.col("real"))
    return everywhere.unionByName(named.groupBy(F.col(scope).cast("string").alias("scope"), key.alias("key")).agg(first("type"), first("real")).select("type", "real", "scope"))


def _bits(values: DataFrame) -> np.ndarray:
    """The filter over a column `v` of strings, as 64-bit words; collects at most BITS / 64 rows."""
    at = F.pmod(F.crc32(F.col("v").cast("binary")), F.lit(BITS))
    out = np.zeros(BITS // 64, np.uint64)
    for word, bits in values.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))"))).collect():
        out[word] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return out


def _holds(bits: np.ndarray, value: str) -> bool:
    at = zlib.crc32(value.encode()) % BITS
    return bool(int(bits[at >> 6]) >> (at & 63) & 1)


def name_hash(secret: bytes, domain: str, value: str) -> str:
    """ids.Key.id in Python."""
    return base64.b32encode(hmac.new(secret, domain.encode() + b"\0" + value.encode(), hashlib.sha256).digest()[:5]).decode().lower()


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn").upper()


def people_in(text: str, people: np.ndarray, sizes: list[int], secret: bytes) -> list[tuple]:
    """(start, end, real, hash) of words and runs of words that may be registered codes and names (of so many words)."""
    out = []
    for m in _CODE.finditer(text):
        if len(m[0]) >= SHORTEST and not m[0].isalpha() and _holds(people, h := name_hash(secret, "usuario", m[0].upper())):
            out.append((m.start(), m.end(), m[0], h))
    run: list[tuple[int, int, str]] = []
    most = max(sizes, default=0)
    for m in _NAME_WORD.finditer(text) if most else ():
        if run and text[run[-1][1] : m.start()].strip(" \t"):
            run = []
        run = [*run[1 - most :], (m.start(), m.end(), _plain(m[0]))] if most > 1 else [(m.start(), m.end(), _plain(m[0]))]
        for n in sizes:
            if n <= len(run):
                h = name_hash(secret, "nome", " ".join(x[2] for x in run[-n:]))
                if _holds(people, h):
                    out.append((run[-n][0], m.end(), text[run[-n][0] : m.end()], h))
    return out


_FIELDS = {"_candidates": lookup.CANDIDATE, "_people": "start int, end int, real string, hash string"}


def _marked(found: DataFrame, text: str, values: lookup.Filter, people: tuple[np.ndarray, list[int]] | None, key: ids.Key) -> DataFrame:
    """found with its candidates: places of values, and of people."""
    sent = found.sparkSession.sparkContext.broadcast((values, people))
    secret = key.secret
    kinds = [StructType.fromDDL(x) for x in _FIELDS.values()]
    names = [k.fieldNames() for k in kinds]
    arrow = [pa.list_(pa.struct([(f, pa.string() if t.dataType.typeName() == "string" else pa.int64() if t.dataType.typeName() == "long" else pa.int32()) for f, t in zip(n, k, strict=True)])) for n, k in zip(names, kinds, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (f, who), hasher = sent.value, lookup.Hasher(secret)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            rows = ([lookup.candidates(x, f, hasher) if x else [] for x in texts], [people_in(x, *who, secret) if x and who else [] for x in texts])
            cols = [pa.array([[dict(zip(n, c, strict=True)) for c in row] for row in some], kind) for n, some, kind in zip(names, rows, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *_FIELDS])

    return found.mapInArrow(run, StructType([*found.schema.fields, *[StructField(n, ArrayType(k)) for n, k in zip(_FIELDS, kinds, strict=True)]]))


def _by_origin(hits: DataFrame, own: DataFrame, found_in: DataFrame, origin: str, data: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """hits without those of names whose first mention in the hit's scope isn't the data's, and of names that this run learned (own: id) in no scope (found_in: _scope, id) where the data
    wrote them first."""
    from_data = F.coalesce(F.col(origin).cast("string").isin(*data), F.lit(False))
    first = hits.groupBy("_scope", "id").agg(F.min_by(from_data, F.struct(*order, "start")).alias("ours"))
    ours = first.where("ours").join(found_in, ["_scope", "id"], "left_semi")
    outside = own.select("id").distinct().join(ours.select("id").distinct(), "id", "left_anti")
    kept = hits.join(first.where(~F.col("ours")).select(F.col("_scope").alias("_s"), F.col("id").alias("_i")), (F.col("_scope") == F.col("_s")) & (F.col("id") == F.col("_i")), "left_anti")
    return kept.join(outside, "id", "left_anti")


def find_corpus(
    texts: DataFrame, key: ids.Key, text: str = "text", config: Config | None = None, readers: tuple[str, ...] = DEFAULT, scope: str | None = None, order: tuple[str, ...] = (), registry: DataFrame | None = None,
    seen: DataFrame | None = None, remember: str | None = None, today: int | None = None, days: int = 90, origin: str | None = None, data: tuple[str, ...] = ("data", "user", "tool"),
    more: tuple[Callable[[DataFrame], DataFrame], ...] = (), words: bool = False,
) -> DataFrame:
    """texts with findings: of detectors, readers, learned values and registered people. scope: a column within which other names apply too;
    order: columns that say which of several decisions came first; registry: of known.import_people; seen: an index that an earlier run wrote to its `remember` (a path), of which what
    was seen within `days` of today (days since the epoch) counts; origin: a column that says who wrote a text, data: its values that are data (others: a model, the web);
    words: names that are plain words count within their scope too, but for places where they are only words (intervals.braked); more: deciders, functions from texts (with _id and findings) to further findings (_id, start, end, type, real, rule, strong), which teach like those of readers. Null texts have no findings; columns
    named _id, _known, _candidates, _people or findings are replaced."""
    config = config or Config()
    base = texts.drop("findings", "_id", "_known", "_candidates", "_people").withColumn("_id", F.monotonically_increasing_id())
    found = written(with_names(detect(base, text, config), text, readers) if readers else detect(base, text, config), "found")
    if more:
        found = _decided(found, more)
    order = order or ("_id",)
    kept = list(dict.fromkeys([*order, *([scope] if scope else []), *([origin] if origin else [])]))
    each = exploded(found, "_id", *[c for c in kept if c != "_id"])
    own = written(lookup.indexed(learn(each, scope, *order, words=words), key), "learned")
    today = (datetime.now(UTC).date() - datetime(1970, 1, 1).date()).days if today is None else today
    index = own if seen is None else written(own.unionByName(lookup.valid(seen, today, days).select(*own.columns)).distinct(), "index")
    if remember:
        lookup.merged(seen, own, today).write.parquet(remember)
    who = None
    if registry is not None:
        registry = written(registry, "registry")
        sizes = [r[0] for r in registry.where("kind = 'name'").select("words").distinct().collect()] if "words" in registry.columns else list(NAME_WORDS)  # a few small numbers
        who = _bits(registry.select(F.col("hash").alias("v"))), sorted(sizes)
    marked = written(_marked(found, text, lookup.filter_of(index), who, key), "candidates")
    dropped(found)
    of = [(F.col(scope).cast("string") if scope else F.lit(None).cast("string")).alias("_scope"), *[F.col(c) for c in kept if c not in ("_id", scope)], *([F.col(scope)] if scope else [])]
    places = marked.where(F.size("_candidates") > 0).select("_id", *of, F.inline("_candidates"))
    hits = lookup.verified(places.select("_id", "_scope", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)], *[c.split()[0] for c in lookup.CANDIDATE.split(", ")]), index, key)
    if origin:
        # without a scope all texts are one
        place = F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")
        found_in = exploded(marked, *([scope] if scope else ["_id"])).select(place.alias("_scope"), key.id(F.lit("visto"), ids.canonical_key(F.col("type"), F.col("real"))).alias("id")).distinct()
        hits = hits.withColumn("_scope", F.coalesce("_scope", F.lit("")))
        hits = _by_origin(written(hits, "mentions"), own, found_in, f"_k{kept.index(origin)}", data, tuple("_id" if c == "_id" else f"_k{kept.index(c)}" for c in order))
    # a name of the scope goes before one of all texts, then by type
    first = F.min_by("type", F.struct(F.col("scope").isNull().alias("everywhere"), "type"))
    spans = hits.groupBy("_id", "start", "end", "real").agg(first.alias("type")).withColumn("rule", F.lit("known"))
    if words:
        # both are read several times
        spans, parts = written(spans, "spans"), written(intervals.segments(marked.where(F.size("_candidates") > 0), "_id", text=text), "segments")
        spans = intervals.braked(spans, parts, "_id")
    if registry is not None:
        people = registry.where("kind in ('name', 'code')").select("hash", F.col("person"), F.when(F.col("kind") == "name", "name").otherwise("user").alias("type")).distinct()
        met = marked.where(F.size("_people") > 0).select("_id", F.inline("_people")).join(people, "hash")
        spans = spans.unionByName(met.select("_id", "start", "end", "real", "type", F.concat(F.lit(mask.PERSON), "person").alias("rule")))
    span = F.struct("start", "end", "type", "real", "rule", F.lit(True).alias("strong"))
    known_ = spans.groupBy("_id").agg(F.collect_list(span).cast(T.SPANS).alias("_known"))  # of one text
    some = marked.where((F.size("_candidates") > 0) | (F.size("_people") > 0))
    rest = marked.where((F.size("_candidates") == 0) & (F.size("_people") == 0))
    with_known = some.join(known_, "_id", "left").withColumn("findings", F.concat("findings", F.coalesce("_known", F.array().cast(T.SPANS)))).drop("_known")
    return rest.unionByName(with_known).drop("_candidates", "_people", "_id")


def _decided(found: DataFrame, more: tuple[Callable[[DataFrame], DataFrame], ...]) -> DataFrame:
    """found whose findings hold those of the deciders too. A written table."""
    each = None
    for decide in more:
        one = decide(found).select("_id", F.struct("start", "end", "type", "real", "rule", "strong").cast(T.SPAN).alias("span"))
        each = one if each is None else each.unionByName(one)
    by = each.distinct().groupBy("_id").agg(F.collect_list("span").alias("_more"))  # of one text
    out = written(found.join(by, "_id", "left").withColumn("findings", F.concat("findings", F.coalesce("_more", F.array().cast(T.SPANS)))).drop("_more"), "decided")
    dropped(found)
    return out


def mask_corpus(texts: DataFrame, key: ids.Key, text: str = "text", config: Config | None = None, **options) -> DataFrame:
    """texts masked by all parts: text, n_replacements and edits (options: of find_corpus)."""
    return mask.mask(find_corpus(texts, key, text, config, **options), key, text, config)
