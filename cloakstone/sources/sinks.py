"""Results as tables: masked rows, mapping, rejected rows, and the state that later runs start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import known, mask


def write_masked(masked: DataFrame, path: str, *keys: str, text: str = "text", mode: str = "errorifexists") -> None:
    """path/masked, path/mapping and path/rejected. Only rows that were masked whole reach `masked`."""
    good, bad = mask.quarantined(masked, *keys, text=text)
    good.drop("edits").write.mode(mode).parquet(f"{path}/masked")
    mask.mapping(good, *keys).write.mode(mode).parquet(f"{path}/mapping")
    bad.write.mode(mode).parquet(f"{path}/rejected")


def save_seen(spark: SparkSession, seen: DataFrame, path: str, run: str) -> DataFrame:
    """The state of earlier runs merged with this one's, written beside them under the run's name; a repeated run replaces its own only."""
    earlier = [r for r in _runs(spark, path) if r < run]
    merged = known.merge_seen(spark.read.parquet(f"{path}/run={earlier[-1]}"), seen) if earlier else seen
    merged.write.mode("overwrite").parquet(f"{path}/run={run}")
    return spark.read.parquet(f"{path}/run={run}")


def _runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the runs that are there, in order: folders of a file system that Spark lists."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName().removeprefix("run=") for s in fs.listStatus(p)) if fs.exists(p) else []


def save_people(registry: DataFrame, path: str) -> DataFrame:
    """The registry of known.import_people (kind, hash, person) as a table: it holds hashes only."""
    registry.select("kind", "hash", "person").distinct().write.mode("overwrite").parquet(path)
    return registry.sparkSession.read.parquet(path)


def write_log(entries: DataFrame, path: str, mode: str = "append") -> None:
    """Log lines of requests (ts, status, replacements, collisions, refused, types: map), as audit.read_log reads them. Nothing of a text is in them."""
    some = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}="), F.col(c).cast("string")))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    refused = F.when(F.col("refused").isNotNull() & (F.col("refused") != ""), F.concat(F.lit('refused="'), F.translate("refused", '"\n', "' "), F.lit('"')))
    line = F.concat_ws(" ", F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit("request"), some("status", "status"), some("replacements", "replacements"), some("collisions", "collisions"), F.when(F.size("types") > 0, F.concat(F.lit("types="), pairs)), refused)
    entries.select(line.alias("value")).write.mode(mode).text(path)


def prune_sent(sent: DataFrame, seen_day: str, today, days: int = 30) -> DataFrame:
    """What was sent, without places that no request has shown for so many days."""
    return sent.where(F.col(seen_day) >= today - days)


def record_sent(masked: DataFrame, positions: DataFrame, *keys: str) -> DataFrame:
    """keys, position, edits (without real values): what was sent at each place of a conversation, to be sent again the same."""
    script = F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["type"].alias("type"), e["pseudo"].alias("pseudo")))
    return masked.join(positions, list(keys)).select(*keys, "position", script.alias("sent"))


def replay(texts: DataFrame, sent: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """texts with `frozen`: the text rebuilt from what was sent at the same position; null if nothing was, or it no longer fits."""
    joined = texts.join(sent.select(*keys, "position", "sent"), [*keys, "position"], "left")
    return joined.withColumn("frozen", F.when(F.col("sent").isNotNull(), mask.spliced(F.col(text), F.col("sent")))).drop("sent")
