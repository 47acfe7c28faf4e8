"""Connected components of a table of edges, in rounds of large-star and small-star over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dropped, written


def _settled(edges: DataFrame) -> bool:
    """Each node has one parent, and no parent has one itself."""
    n, nodes = edges.agg(F.count("*"), F.count_distinct("a")).first()
    return n == nodes and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def _starred(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each u with neighbours v: the least of all, m, becomes the neighbour of each v (second result). The minima (first result) are
    written, so the join has two plain shuffles and Spark can split the rows of a hub."""
    least = written(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    return least, pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the least node of its component. Nodes are of any type that orders; loops are allowed.
    Rounds go on until nothing changes; their number grows with the logarithm of the nodes. A round's tables go when the next one is written."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not _settled(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least, joined = _starred(both)
        large = written(joined.where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        dropped(now, least)
        least, down = _starred(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = down.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = written(small.distinct(), "small")
        dropped(large, least)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
