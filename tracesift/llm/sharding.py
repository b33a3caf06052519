"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard levels. At each node every child draws `-ln(u) / weight` from a
hash of (doc_id, level, child) and the least draw wins, so a child gets rows in proportion to its weight
and a changed weight moves rows only into or out of that child's subtree. A new shard comes in a region
of its own: every row either stays or goes to the new shard.

Defined cases: a null text has size 1 and CRC 0; a null doc_id is hashed like any other value, so all
such rows share a shard; repeated rows are kept, each with a slot of its own; further columns of the
input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, gapless, table

#: Region -> rack -> shard -> weight.
Tree = dict[int, dict[int, dict[int, float]]]


def even_tree(shards: int, regions: int = 2, racks: int = 2) -> Tree:
    """Shards 0.. dealt over regions and racks, all of weight 1."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard * regions * racks // shards
        tree.setdefault(rack // racks, {}).setdefault(rack, {})[shard] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, under a region and a rack of its own."""
    rack = max(r for racks in tree.values() for r in racks) + 1
    return tree | {max(tree) + 1: {rack: {shard: weight}}}


def _weight(node: dict | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _choose(key: Column, level: str, children: dict) -> Column:
    """The child with the least draw; ties go to the smaller id."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = []
    for child, node in sorted(children.items()):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(child)), 11).cast("double") + 1.0) / float(2**53)
        draws.append(F.struct((-F.log(u) / _weight(node)).alias("draw"), F.lit(child).alias("child")))
    return F.least(*draws)["child"]


def _case(value: Column, branches: dict[int, Column]) -> Column:
    out = None
    for k, branch in sorted(branches.items()):
        out = F.when(value == k, branch) if out is None else out.when(value == k, branch)
    return out


def place(df: DataFrame, key: str, tree: Tree, prefix: str = "") -> DataFrame:
    """Adds region, rack and shard, each level drawn among the children of the one above."""
    region, rack, shard = (prefix + c for c in ("region", "rack", "shard"))
    k = F.col(key)
    df = df.withColumn(region, _choose(k, "region", tree))
    df = df.withColumn(rack, _case(F.col(region), {r: _choose(k, "rack", racks) for r, racks in tree.items()}))
    leaves = {r: shards for racks in tree.values() for r, shards in racks.items()}
    return df.withColumn(shard, _case(F.col(rack), {r: _choose(k, "shard", shards) for r, shards in leaves.items()}))


def assign(docs: DataFrame, tree: Tree, new_shard: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard and, with `new_shard`, the shard in the grown tree.

    Sizes are UTF-8 bytes plus 1. No shuffle: the row's id alone decides.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows = place(rows, "doc_id", tree)
    if new_shard is None:
        return rows.withColumn("grown_shard", F.lit(None).cast("int"))
    return place(rows, "doc_id", grown(tree, new_shard), "grown_").drop("grown_region", "grown_rack")


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row with its shard and a gapless slot in it."""
    scratch = Scratch(spark, "sharding")
    placed = scratch.write(assign(docs, even_tree(shards), shards).withColumn("pid", F.spark_partition_id()), "placed")
    return gapless(scratch, placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot").drop("pid")


def op8_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(spark, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
