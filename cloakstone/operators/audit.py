"""Audit and measurement: counts by type and day, refusals, latency percentiles, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def by_type(mapping: DataFrame, *scope: str) -> DataFrame:
    """Distinct pseudonyms of each type, in each scope."""
    return mapping.groupBy(*scope, "type").agg(F.count_distinct("pseudo").alias("n_distinct"))


def top_counts(df: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """key, n by count, then key; the first `most` of them (a report)."""
    out = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)
    return out if most is None else out.limit(most)


def percentiles(df: DataFrame, value: str, at: tuple[float, ...] = (0.5, 0.95, 1.0)) -> DataFrame:
    """p, value: the element of rank (n - 1) * p, rounded down. Counts of distinct values are dealt by ranges of value; a range's ranks begin
    behind the sum of the ranges before it, so no task sees more than its range."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    dealt = written(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "percentiles")
    sums = dealt.groupBy("part").agg(F.sum("n").alias("of_part"))  # a row a partition
    before = sums.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("before"))
    points = sums.agg(F.sum("of_part").alias("total")).select(F.explode(F.array(*map(F.lit, at))).alias("p"), "total").select("p", F.floor((F.col("total") - 1) * F.col("p")).alias("rank"))
    last = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    ranked = dealt.join(before, "part").select("value", "n", last.alias("last"))
    return ranked.join(F.broadcast(points), (F.col("rank") >= F.col("last") - F.col("n")) & (F.col("rank") < F.col("last"))).select("p", "value")  # points: a row for each p


def period_seconds(period: Column) -> Column:
    """Seconds of '24h', '90m', '30s', '7d', or a bare number of hours; null if it isn't one."""
    n = F.regexp_extract(period, r"^([0-9]+)(d|h|m|s)?$", 1)
    unit = F.regexp_extract(period, r"^([0-9]+)(d|h|m|s)?$", 2)
    scale = F.when(unit == "d", 86400).when(unit == "m", 60).when(unit == "s", 1).otherwise(3600)
    return F.when((n != "") & (n.cast("long") > 0), n.cast("long") * scale)


LOG = r"^([0-9]{4}[/-][0-9]{2}[/-][0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})[^ ]* (.*)$"


def read_log(lines: DataFrame) -> DataFrame:
    """ts, status, replacements, collisions, refused, types of each stamped line (value); others are left out."""
    stamp, rest = F.regexp_extract("value", LOG, 1), F.regexp_extract("value", LOG, 2)
    number = lambda name: F.regexp_extract(rest, rf"\b{name}=([0-9]+)", 1).try_cast("long")
    pairs = F.regexp_extract(rest, r"\btypes=([a-z0-9_.:=,]+)", 1)
    types = F.when(pairs != "", F.str_to_map(pairs, F.lit(","), F.lit(":")))
    return lines.where(stamp != "").select(
        F.try_to_timestamp(F.translate(stamp, "/", "-"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), number("status").alias("status"), number("replacements").alias("replacements"),
        number("collisions").alias("collisions"), F.regexp_extract(rest, r"\brefused=\"?([^\"]+)\"?", 1).alias("refused"), types.alias("types"),
    )


def by_status(log: DataFrame) -> DataFrame:
    """status, n of a parsed log."""
    return log.where("status is not null").groupBy("status").agg(F.count("*").alias("n"))


def refusals(log: DataFrame) -> DataFrame:
    """refused (the reason), n of a parsed log, most first."""
    return top_counts(log.where("refused <> ''"), "refused")


def summary(log: DataFrame, since: Column | None = None) -> DataFrame:
    """One row: requests, not_ok, replacements, collisions, refused of a parsed log."""
    rows = log if since is None else log.where(F.col("ts") >= since)
    return rows.agg(
        F.count("status").alias("requests"), F.count_if(~F.col("status").between(200, 299)).alias("not_ok"), F.coalesce(F.sum("replacements"), F.lit(0)).alias("replacements"),
        F.coalesce(F.sum("collisions"), F.lit(0)).alias("collisions"), F.count_if(F.col("refused") != "").alias("refused"),
    )


def masked_by_type(log: DataFrame) -> DataFrame:
    """type, n over a parsed log, most first."""
    each = log.select(F.explode("types").alias("type", "n"))
    return each.groupBy("type").agg(F.sum(F.col("n").cast("long")).alias("n")).orderBy(F.desc("n"), "type")
