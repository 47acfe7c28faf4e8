"""Sharding by a hierarchical weighted hash tree: a key descends region, rack and shard levels, at each node by a weighted draw.

Leaves are numbered in tree order: a region holds RACKS racks of RACK_SHARDS shards; of the shards that the tree was laid out for (`base`), only
the last region and rack may be partly filled. A shard added later opens a region of its own. A node weighs as many shards as it holds. At a node each child draws -ln(u) / weight, u from a hash of key and child,
and the least draw wins. A child's draw depends on nothing but the key, the child and its own weight, so a weight that grows pulls
keys into that child's subtree and moves no key between other children. An added shard changes one subtree, itself, so keys move
only into it, whatever the counts: the `key` law. (Laying the tree out anew, with another base, moves keys between regions.)

Slots: rows of a shard are numbered without gaps from per-split counts and prefix sums; no task holds a whole shard.

Defined results: a null doc_id is a key of its own ("null"); repeated doc_ids share a shard and have different slots; null text has
size 16 and the checksum of the empty string; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

RACK_SHARDS = 5
RACKS = 2
ROW_BYTES = 16


def tree(shards: int, base: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """[(weight, [(weight, [shard, ...]) of each rack]) of each region]."""
    first = min(shards, base)
    racks = [list(range(i, min(i + RACK_SHARDS, first))) for i in range(0, first, RACK_SHARDS)]
    regions = [racks[i : i + RACKS] for i in range(0, len(racks), RACKS)] + [[[s]] for s in range(base, shards)]
    return [(sum(map(len, r)), [(len(x), x) for x in r]) for r in regions]


def _draw(key: Column, node: str, weight: int) -> Column:
    """Exponential draw of a child: 52 bits of a digest as u in (0, 1)."""
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{node}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / float(weight)


def _least(key: Column, children: list[tuple[str, int, Column]]) -> Column:
    """The value of the child with the least draw; ties go to the first."""
    if len(children) == 1:
        return children[0][2]
    return F.array_min(F.array(*[F.struct(_draw(key, name, w).alias("d"), F.lit(i).alias("i"), value.alias("v")) for i, (name, w, value) in enumerate(children)]))["v"]


def _descend(key: Column, shards: int, base: int) -> Column:
    """The region is drawn first; only the winner's subtree is drawn then."""
    at = tree(shards, base)
    region = _least(key, [(f"region{i}", w, F.lit(i)) for i, (w, _) in enumerate(at)])

    def below(i: int) -> Column:
        racks = at[i][1]
        rack = _least(key, [(f"region{i}/rack{j}", w, F.lit(j)) for j, (w, _) in enumerate(racks)])
        leaves = [_least(key, [(f"shard{s}", 1, F.lit(s)) for s in shard]) for _, shard in racks]
        out = leaves[-1]
        for j in reversed(range(len(leaves) - 1)):
            out = F.when(rack == j, leaves[j]).otherwise(out)
        return out

    out = below(len(at) - 1)
    for i in reversed(range(len(at) - 1)):
        out = F.when(region == i, below(i)).otherwise(out)
    return out


def shard_of(key: Column, shards: int, base: int | None = None) -> Column:
    """The shard of a key among so many; base: the number that the tree was laid out for (all of them by default)."""
    return _descend(F.coalesce(key.cast("string"), F.lit("null")), shards, base or shards).cast("int")


def assign(docs: DataFrame, shards: int = 40, base: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs (doc_id, text)."""
    base = base or shards
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        shard_of(F.col("doc_id"), shards, base).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1, base).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_at"),
    )
    placed = C.written(placed, "placed")  # the numbering below reads fixed row numbers
    part = F.shiftright("_at", 33)
    counts = placed.groupBy("shard", part.alias("_part")).count()
    # one row for each shard and input split
    offsets = counts.select("shard", "_part", (F.sum("count").over(Window.partitionBy("shard").orderBy("_part")) - F.col("count")).alias("_offset"))
    local = placed.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_at")))
    return local.join(offsets, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_offset") + F.col("_n") - 1).cast("long").alias("slot"), "grown_shard"
    )
