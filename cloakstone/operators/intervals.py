"""Intervals of two tables held against each other, and what part of a text a place stands in: comment, quotes, prose or code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import written
from . import known

#: Width of the least bins, in characters.
WIDTH = 1024


def _binned(start: Column, end: Column, level: Column) -> Column:
    """The bins of a level (of WIDTH * 2^level characters) that an interval touches."""
    width = F.lit(WIDTH) * F.pow(F.lit(2.0), level).cast("long")
    return F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))


def last_overlapping(places: DataFrame, spans: DataFrame, *keys: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """places (keys, start, end, others; distinct) with the columns carry of the last span (of spans: keys, start, end, carry; by start, then end, then carry) that overlaps each, or nulls.

    A join by bins: a span stands in bins about as wide as itself, two at most, and a place looks into the bins of each width that there is (some 20 numbers are collected). So a
    key that holds a third of all rows is dealt by its bins, nothing is compared in all pairs, and a span over a whole text costs no more than a short one."""
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("end") - F.col("start"), F.lit(1)) / WIDTH))).cast("int")
    right = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("start").alias("_start"), F.col("end").alias("_end"), level.alias("_level"), F.struct(*carry).alias("_carry"))
    levels = [r[0] for r in right.select("_level").distinct().collect()]
    left = places.withColumn("_place", F.struct("start", "end")).select("*", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("_l"))
    left = left.withColumn("_bin", F.explode(_binned(F.col("start"), F.col("end"), F.col("_l"))))
    right = right.withColumn("_b", F.explode(_binned(F.col("_start"), F.col("_end"), F.col("_level"))))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_l") == F.col("_level"), F.col("_bin") == F.col("_b")]
    met = left.join(right, on).where((F.col("_start") < F.col("end")) & (F.col("start") < F.col("_end")))
    best = met.groupBy(*keys, "start", "end").agg(F.max(F.struct("_start", "_end", "_carry")).alias("_best"))
    named = best.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("start").alias("_s"), F.col("end").alias("_e"), "_best")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("start") == F.col("_s"), F.col("end") == F.col("_e")]
    return places.join(named, same, "left").select(*[places[c] for c in places.columns], *[F.col(f"_best._carry.{c}").alias(c) for c in carry])


_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|(?<![\p{L}\p{N}])'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
#: A mark at the beginning of a line or behind a blank; an option (--schema=x) and a number (#3) are none.
_COMMENT = r"(?m)(?:^|(?<=[ \t]))(?:--(?![\p{L}\p{N}])|//|/\*|#(?![0-9]))[^\n]*"
#: Words in capitals throughout are no prose.
_PROSE = r"(?<![\p{L}\p{N}_.\-/\\$@:=])(?:\p{Lu}?\p{Ll}+|\p{Lu})(?:[,;]? (?:\p{Lu}?\p{Ll}+|\p{Lu})(?!\p{L})){2,}(?![\p{L}\p{N}_\-/\\$@=(])"


def segments(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, start, end, kind of the comments, quoted parts and running prose (three words and more) of texts; what none of them covers is code. A mark inside quotes begins no comment."""
    t = F.col(text)
    kind = lambda m: F.when(m.rlike(r"^[\"'`]"), "quoted").otherwise("comment")
    one = lambda name: lambda x, at: F.when(x["match"].isNotNull(), F.struct(at.cast("int").alias("start"), (at + F.length(x["match"])).cast("int").alias("end"), name(x["match"]).alias("kind")))
    both = F.concat(F.array_compact(T.located(t, f"{_QUOTED}|{_COMMENT}", 0, one(kind))), F.array_compact(T.located(t, _PROSE, 0, one(lambda _: F.lit("prose")))))
    return texts.where(t.isNotNull()).select(*keys, F.inline(both))


def braked(spans: DataFrame, parts: DataFrame, *keys: str) -> DataFrame:
    """spans (keys, start, end, type, real, ...) of remembered names without those that are only words where they stand: a common word in a comment, a common word that names a column or an index in prose.
    parts: of segments(). A name with the shape of an identifier counts anywhere."""
    common = ~known.identifier_shape(F.col("real"))
    column = F.col("type").isin("obj.column", "obj.index")
    some = spans.where(common)
    where = lambda kind: parts.where(F.col("kind") == kind).select(*keys, "start", "end", F.lit(True).alias(kind))
    outside = written(last_overlapping(some, where("comment"), *keys, carry=("comment",)).where("comment is null").drop("comment"), "outside")
    told = last_overlapping(outside, where("prose"), *keys, carry=("prose",))
    kept = told.where(F.col("prose").isNull() | ~column).select(*spans.columns)
    return spans.where(~common).unionByName(kept)
