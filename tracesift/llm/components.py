"""Connected components of an edge table by alternating large and small stars.

Each round every node hands its larger neighbours (then its smaller ones) to the least of them, with one
partial aggregation for the least and one join; no neighbour list is ever gathered. The rounds end when the
edges are stars about each component's least node, after about log2(diameter) squared rounds at most.

A round is about a dozen stages, however few the edges, and each of their tasks costs the driver memory for a while. So
a caller may name a number of edges up to which one task finds the components instead; beyond it the rounds do.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back

#: Edges that one task may hold: some 8 MB of names of 16 bytes.
WHOLE = 1 << 18


def _star(scratch: Scratch, name: str, both: DataFrame, larger: bool) -> DataFrame:
    """`both` holds (u, v) with the neighbours to look at; those that are larger (or not) go to the least.

    The least are stored first, so that the join's sides are plain shuffles and a hub's edges can be split.
    """
    least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
    near = both.join(least, "u")
    if larger:
        near = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        near = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return near.filter("u > v").distinct()


def _joined(batches):
    """All edges of a table, to (node, component)."""
    edges = pa.Table.from_batches(list(batches))  # there is an edge at least
    ends = [edges.column(c).combine_chunks() for c in ("u", "v")]
    nodes = pc.unique(pa.concat_arrays(ends))
    nodes = nodes.take(pc.array_sort_indices(nodes))
    root = list(range(len(nodes)))
    for a, b in zip(*[pc.index_in(x, value_set=nodes).to_pylist() for x in ends], strict=True):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        root[max(a, b)] = min(a, b)
    for k, above in enumerate(root):  # no root is above its nodes, so those before are done
        root[k] = root[above]
    yield from pa.table({"node": nodes, "component": nodes.take(pa.array(root, pa.int64()))}).to_batches(50_000)
    give_back()


def components(scratch: Scratch, edges: DataFrame, name: str = "stars", whole: int = 0) -> DataFrame:
    """Edges (u, v) of any order type to (node, component): each node that has an edge, and its component's least node.

    Up to `whole` edges one task finds them, by a union of sets; more take rounds.
    """
    now = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), f"{name}-0")
    mark, turn = None, 0
    while True:
        got = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (got["n"], got["x"]) == mark or not got["n"]:
            break
        if got["n"] <= whole:
            kind = now.schema["u"].dataType.simpleString()
            return scratch.write(now.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}"), f"{name}-whole")
        mark, turn = (got["n"], got["x"]), turn + 1
        large = _star(scratch, f"{name}-m{turn}", now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), True)
        large = scratch.write(large, f"{name}-l{turn}")
        now = scratch.write(_star(scratch, f"{name}-s{turn}", large, False), f"{name}-{turn}")
        scratch.drop(f"{name}-l{turn}", f"{name}-m{turn}", f"{name}-s{turn}", f"{name}-{turn - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
