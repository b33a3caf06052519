"""Nearest neighbours by inner product with vantage-point trees, one for each shard.

Inner products become distances: with R the largest norm, x goes to (x, sqrt(R^2 - |x|^2)) and a query q to
(q, 0), and the nearest by distance has the largest inner product. A node keeps a vantage point and how far
its two halves lie from it; by the triangle inequality a half is at least so far from the query, and is left
out where `factor` times that bound exceeds the k-th best distance so far. Factor 1 is exact search; larger
factors leave out more and may miss some.

Shards are regions of space: a tree over a bounded sample deals every vector to a region, and the least and
greatest distances of a region's vectors from the vantage points above it are taken over all of them. A query
searches the region it falls into first; then only regions that the same bound does not rule out. A region of more
than SHARD vectors is several shards.

Equal vectors are one class that keeps its k + 1 smallest ids, enough for any answer, so copies cost
nothing; queries that share a vector are searched once. Trees are built once, stored, and met by the queries
in blocks: (shard, block) pairs, each of bounded size. Scores are summed again in component order in double
precision, so equal vectors have equal scores and ties go to the smaller id; rows whose rounded score might change
places with the last one wanted are all scored so, however many.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors meet
only vectors of their length; rows equal in id and vector count once; of rows that share an id but not the
vector, a query leaves out all with its id; a null id is no query and no candidate; vectors may be of any length that
fits a row; further columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

NEAREST, FACTOR, EVERY = 20, 1.0, 20
#: Distinct vectors in a shard's tree and in a leaf, queries in a block, and classes kept beyond those asked for before all near ties are.
SHARD, LEAF, BLOCK, SPARE = 25_000, 256, 20_000, 11
#: Vectors of each length that the regions are cut by, and of those in a region at least.
SAMPLE, REGION = 4096, 16
#: Parts in which a class's smallest ids are found before they meet.
SALT = 64


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) with v in double precision, without the rows that take no part."""
    v = F.col(vector_column)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(sound)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


class Tree:
    """A vantage-point tree over the rows of x, of which position order is id order."""

    def __init__(self, x: np.ndarray, radius2: float, leaf: int = LEAF, seed: int = 7):
        self.x, self.radius2 = x, radius2
        tail = np.sqrt(np.maximum(0.0, radius2 - np.einsum("ij,ij->i", x, x)))
        self.y = np.column_stack([x, tail])
        self.leaves: list[np.ndarray] = []
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(x)), leaf, np.random.Generator(np.random.PCG64(seed)))
        del self.y

    def _build(self, rows: np.ndarray, leaf: int, rng) -> int:
        """Index of the node, or -1 - index of the leaf."""
        if len(rows) <= leaf:
            self.leaves.append(np.sort(rows))
            return -len(self.leaves)
        vantage = rows[rng.integers(len(rows))]
        d = np.sqrt(np.maximum(0.0, ((self.y[rows] - self.y[vantage]) ** 2).sum(axis=1)))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        at = len(self.nodes)
        self.nodes.append(())
        bounds = (float(d[near].min()), float(d[near].max()), float(d[far].min()), float(d[far].max()))
        self.nodes[at] = (int(vantage), bounds, self._build(rows[near], leaf, rng), self._build(rows[far], leaf, rng))
        return at

    def search(self, q: np.ndarray, keep: int, need: int, factor: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the `keep` best positions (-1: none) and scores, by score and then position; what lies below a score `known` to be reached may be left out."""
        n = len(q)
        self.known = np.full(n, -np.inf) if known is None else known
        self.q, self.q2 = q, np.einsum("ij,ij->i", q, q)
        self.scores, self.found = np.full((n, keep), -np.inf), np.full((n, keep), -1, dtype=np.int64)
        self.first = np.full(n, 1, dtype=np.int64)
        self.slack = 1e-9 * (1.0 + np.sqrt(self.q2 + self.radius2))
        everyone = np.arange(n)
        self._descend(self.root, everyone)
        self._visit(self.root, everyone, need, factor)
        return self.found, self.scores

    def _distance(self, vantage: int, who: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.q2[who] + self.radius2 - 2.0 * (self.q[who] @ self.x[vantage])))

    def _descend(self, node: int, who: np.ndarray) -> None:
        """Each query's nearest leaf first, so that there is something to prune by."""
        if not len(who):
            return
        if node < 0:
            self.first[who] = node
            self._leaf(node, who)
            return
        vantage, (_, near, far, _), left, right = self.nodes[node]
        d = self._distance(vantage, who)
        nearer = d < (near + far) / 2
        self._descend(left, who[nearer])
        self._descend(right, who[~nearer])

    def _visit(self, node: int, who: np.ndarray, need: int, factor: float) -> None:
        if not len(who):
            return
        if node < 0:
            self._leaf(node, who[self.first[who] != node])
            return
        vantage, bounds, left, right = self.nodes[node]
        for (low, high), child in ((bounds[:2], left), (bounds[2:], right)):
            d = self._distance(vantage, who)
            least = np.maximum(0.0, np.maximum(low - d, d - high))
            kth = np.maximum(self.scores[who, need - 1], self.known[who])
            worst = np.sqrt(np.maximum(0.0, self.q2[who] + self.radius2 - 2.0 * np.where(np.isfinite(kth), kth, -1e300)))
            self._visit(child, who[factor * least <= worst + self.slack[who]], need, factor)

    def _leaf(self, node: int, who: np.ndarray) -> None:
        rows = self.leaves[-1 - node]
        for a in range(0, len(who), 2048):
            some = who[a : a + 2048]
            s = self.q[some] @ self.x[rows].T
            better = s.max(axis=1) >= self.scores[some, -1]
            some, s = some[better], s[better]
            if not len(some):
                continue
            scores = np.concatenate([self.scores[some], s], axis=1)
            found = np.concatenate([self.found[some], np.broadcast_to(rows, s.shape)], axis=1)
            order = np.lexsort((found, -scores), axis=1)[:, : self.scores.shape[1]]
            self.scores[some] = np.take_along_axis(scores, order, axis=1)
            self.found[some] = np.take_along_axis(found, order, axis=1)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in component order."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def _index(key, rows: pa.Table, radius2: dict[int, float]) -> pa.Table:
    dim = int(key[0].as_py())
    ids = rows.column("ids").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: ids[k][0])
    x = _matrix(rows.column("v"), dim)[order]
    data = pickle.dumps((Tree(x, radius2[dim]), [ids[k] for k in order]), protocol=5)
    return pa.table({"dim": pa.array([dim], pa.int32()), "region": pa.array([key[1].as_py()], pa.int32()), "piece": pa.array([key[2].as_py()], pa.int32()), "tree": pa.array([data], pa.binary())})


class Regions:
    """A vantage-point tree over a sample whose leaves are regions; nodes hold their vantage point and the distance that parts them."""

    def __init__(self, x: np.ndarray, radius2: float, regions: int, seed: int = 11):
        self.radius2, self.vantage, self.paths = radius2, [], []
        self.nodes: list[tuple[float, int, int]] = []
        y = self.lifted(x, True)
        self._build(y, regions, (), np.random.Generator(np.random.PCG64(seed)))
        self.vantage = np.array(self.vantage).reshape(len(self.nodes), y.shape[1])
        self.bounds: dict[int, np.ndarray] = {}  # region -> (low, high) for each node above it

    def lifted(self, x: np.ndarray, data: bool) -> np.ndarray:
        """Points of the space in which the nearest has the largest inner product."""
        tail = np.sqrt(np.maximum(0.0, self.radius2 - np.einsum("ij,ij->i", x, x))) if data else np.zeros(len(x))
        return np.column_stack([x, tail])

    def _build(self, y: np.ndarray, regions: int, path: tuple[int, ...], rng) -> int:
        """Index of the node, or -1 - number of the region."""
        if regions <= 1 or len(y) < 2 * REGION:
            self.paths.append(path)
            return -len(self.paths)
        vantage = y[rng.integers(len(y))]
        d = np.sqrt(((y - vantage) ** 2).sum(axis=1))
        middle, at = float(np.median(d)), len(self.nodes)
        self.nodes.append((middle, 0, 0))
        self.vantage.append(vantage)
        near = d < middle
        left = self._build(y[near], regions // 2, (*path, at), rng)
        right = self._build(y[~near], regions - regions // 2, (*path, at), rng)
        self.nodes[at] = (middle, left, right)
        return at

    def distances(self, y: np.ndarray) -> np.ndarray:
        """From each point to each node's vantage point."""
        d2 = np.einsum("ij,ij->i", y, y)[:, None] + np.einsum("ij,ij->i", self.vantage, self.vantage)[None, :] - 2.0 * (y @ self.vantage.T)
        return np.sqrt(np.maximum(0.0, d2))

    def of(self, d: np.ndarray) -> np.ndarray:
        """The region that points with these distances fall into."""
        at = np.full(len(d), 0 if self.nodes else -1)
        while (at >= 0).any():
            who = np.flatnonzero(at >= 0)
            middle, left, right = (np.array(c)[at[who]] for c in zip(*self.nodes, strict=True))
            at[who] = np.where(d[who, at[who]] < middle, left, right)
        return -1 - at

    def least(self, d: np.ndarray) -> np.ndarray:
        """For each point and region a distance that no vector of the region is nearer than; infinity where it has none."""
        out = np.full((len(d), len(self.paths)), np.inf)
        for region, (low, high) in self.bounds.items():
            path = list(self.paths[region])
            gaps = np.maximum(low - d[:, path], d[:, path] - high)
            out[:, region] = np.maximum(0.0, gaps.max(axis=1)) if path else 0.0
        return out


def _by_dim(batch: pa.RecordBatch):
    """(dim, rows of the batch, their vectors) for each vector length in it."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = batch.take(pa.array(np.flatnonzero(dims == dim)))
        yield dim, part, np.asarray(part.column("v").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _placed(batches, tops):
    """Adds each vector's region, and its distances from the vantage points above that."""
    for batch in batches:
        for dim, part, x in _by_dim(batch):
            top = tops.value[dim]
            d = top.distances(top.lifted(x, True))
            region = top.of(d)
            far = [d[k, list(top.paths[r])].tolist() for k, r in enumerate(region.tolist())]
            yield pa.record_batch([*part.columns, pa.array(region, pa.int32()), pa.array(far, pa.list_(pa.float64()))], names=[*part.schema.names, "region", "far"])


def _homes(batches, tops):
    """The region that each query falls into."""
    for batch in batches:
        for dim, part, q in _by_dim(batch):
            top = tops.value[dim]
            region = top.of(top.distances(top.lifted(q, False)))
            # one that holds vectors: the nearest by bound, if the query's own has none
            for k in np.flatnonzero([r not in top.bounds for r in region.tolist()]).tolist():
                region[k] = int(np.argmin(top.least(top.distances(top.lifted(q[k : k + 1], False)))[0]))
            yield pa.record_batch([part.column("uid"), part.column("dim"), pa.array(region, pa.int32()), pa.nulls(len(q), pa.float64())], names=["uid", "dim", "region", "known"])


def _others(batches, tops, factor: float):
    """(query, region) for the regions besides its first that the bound does not rule out."""
    for batch in batches:
        for dim, part, q in _by_dim(batch):
            top = tops.value[dim]
            known = part.column("known").to_numpy(zero_copy_only=False).astype(np.float64)
            q2 = np.einsum("ij,ij->i", q, q)
            worst = np.sqrt(np.maximum(0.0, q2 + top.radius2 - 2.0 * np.where(np.isfinite(known), known, -1e300)))
            least = top.least(top.distances(top.lifted(q, False)))
            least[np.arange(len(q)), part.column("region").to_numpy()] = np.inf
            slack = 1e-9 * (1.0 + np.sqrt(q2 + top.radius2))
            row, region = np.nonzero(np.isfinite(least) & (factor * least <= (worst + slack)[:, None]))
            yield pa.record_batch([part.column("uid").take(pa.array(row)), part.column("dim").take(pa.array(row)), pa.array(region, pa.int32()), pa.array(known[row])], names=["uid", "dim", "region", "known"])


def _search(key, queries: pa.Table, trees: pa.Table, nearest: int, factor: float) -> pa.Table:
    """The best nearest + 1 rows of a shard for each query class of a block."""
    dim, uids, ids, scores = int(key[0].as_py()), [], [], []
    if queries.num_rows and trees.num_rows:
        tree, members = pickle.loads(trees.column("tree")[0].as_py())
        q, uid, need = _matrix(queries.column("v"), dim), queries.column("uid").to_numpy(), nearest + 1
        known = queries.column("known").to_numpy().astype(np.float64)
        found, rounded = tree.search(q, need + SPARE, need, factor, np.where(np.isfinite(known), known, -np.inf))
        row, column = np.nonzero(found >= 0)
        position = found[row, column]
        # where rounding might let rows past the spare ones into the answer, all that are near enough are scored
        error = 1e-14 * dim * np.sqrt(np.einsum("ij,ij->i", q, q) * tree.radius2)
        for k in np.flatnonzero((found[:, -1] >= 0) & (rounded[:, -1] >= rounded[:, need - 1] - error)).tolist():
            more = np.setdiff1d(np.flatnonzero(tree.x @ q[k] >= rounded[k, need - 1] - error[k]), found[k])
            row, position = np.concatenate([row, np.full(len(more), k)]), np.concatenate([position, more])
        exact = _exact(q[row], tree.x[position])
        best: list[list[tuple[float, int]]] = [[] for _ in range(len(q))]
        for r, p, score in zip(row.tolist(), position.tolist(), exact.tolist(), strict=True):
            best[r].extend((-score, i) for i in members[p])
        for u, rows in zip(uid.tolist(), best, strict=True):
            rows = sorted(rows)[:need]
            uids += [u] * len(rows)
            scores += [-s for s, _ in rows]
            ids += [i for _, i in rows]
    return pa.table({"uid": pa.array(uids, pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})


def _best(found: DataFrame, n: int) -> DataFrame:
    return found.withColumn("n", F.row_number().over(W.partitionBy("uid").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= n)


def search(spark: SparkSession, vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = EVERY, nearest: int = NEAREST, factor: float = FACTOR, shard_rows: int = SHARD, block_rows: int = BLOCK, regions: int | None = None) -> DataFrame:
    """query_id, rank, id, score: the nearest rows of each row whose id is divisible by `every`."""
    scratch = Scratch(spark, "vptree")
    rows = scratch.write(usable(vectors, id_column, vector_column).withColumn("dim", F.size("v")), "rows")
    # classes of equal vectors with their smallest ids, found in parts so that no class is gathered
    part = F.pmod(F.xxhash64("id"), F.lit(SALT)).alias("part")
    some = rows.select("id", "v", "dim", part).distinct()
    for by in (["v", "part"], ["v"]):
        some = some.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("id"))).filter(F.col("n") <= nearest + 1).drop("n")
    classes = some.groupBy("v", "dim").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = scratch.write(classes.withColumns({"uid": F.monotonically_increasing_id(), "norm2": F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)}), "classes")
    # a row for each vector length, and at most SAMPLE vectors of each
    sizes = {r["dim"]: r for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("norm2")).collect()}
    sample = classes.withColumn("n", F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("uid"), "uid"))).filter(F.col("n") <= SAMPLE)
    points: dict[int, list] = {d: [] for d in sizes}
    for r in sample.select("dim", "v").collect():
        points[r["dim"]].append(r["v"])
    tops = {d: Regions(np.array(points[d]), r["norm2"] * (1 + 1e-9), regions or -(-r["n"] // shard_rows)) for d, r in sizes.items()}
    sent = spark.sparkContext.broadcast(tops)
    placed = classes.select("uid", "dim", "v", "ids").mapInArrow(partial(_placed, tops=sent), "uid long, dim int, v array<double>, ids array<long>, region int, far array<double>")
    placed = scratch.write(placed, "placed")
    depth = max([len(p) for t in tops.values() for p in t.paths], default=0)
    edges = [f(F.get("far", F.lit(k))).alias(f"{name}{k}") for k in range(depth) for name, f in (("low", F.min), ("high", F.max))]
    shards = []
    for r in placed.groupBy("dim", "region").agg(F.count(F.lit(1)).alias("n"), *edges).collect():  # a row for each region
        path = tops[r["dim"]].paths[r["region"]]
        tops[r["dim"]].bounds[r["region"]] = np.array([[r[f"{name}{k}"] for k in range(len(path))] for name in ("low", "high")])
        shards.append((r["dim"], r["region"], -(-r["n"] // shard_rows)))
    sent = spark.sparkContext.broadcast(tops)
    pieces = F.broadcast(spark.createDataFrame(shards, "dim int, region int, pieces int"))
    radius2 = {d: t.radius2 for d, t in tops.items()}
    dealt = placed.join(pieces, ["dim", "region"]).withColumn("piece", F.pmod(F.xxhash64("uid"), "pieces").cast("int"))
    trees = dealt.select("dim", "region", "piece", "v", "ids").groupBy("dim", "region", "piece")
    trees = scratch.write(trees.applyInArrow(lambda key, rows: _index(key, rows, radius2), "dim int, region int, piece int, tree binary"), "trees")
    asked = scratch.write(rows.filter(F.col("id") % every == 0).select("id", "v").join(classes.select("v", "uid", "dim"), "v").select(F.col("id").alias("query_id"), "uid", "dim").distinct(), "asked")
    queries = scratch.write(classes.select("uid", "dim", "v").join(asked.select("uid").distinct(), "uid", "left_semi"), "queries")

    def met(pairs: DataFrame, name: str) -> DataFrame:
        """What the queries of (query, region) pairs find in all shards of the region."""
        pairs = scratch.write(pairs, f"{name}-pairs")
        count = pairs.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")).collect()  # a row for each region
        blocks = lambda: F.broadcast(spark.createDataFrame([tuple(r) for r in count], "dim int, region int, blocks int"))
        left = pairs.join(blocks(), ["dim", "region"]).join(pieces, ["dim", "region"]).withColumn("block", F.pmod(F.xxhash64("uid"), "blocks").cast("int"))
        left = left.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).join(queries.select("uid", "v"), "uid")
        right = trees.join(blocks(), ["dim", "region"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ["dim", "region", "piece", "block"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda key, left, right: _search(key, left, right, nearest, factor), "uid long, id long, score double")
        return scratch.write(_best(found, nearest + 1).drop("n"), name)

    pair = "uid long, dim int, region int, known double"
    first = scratch.write(queries.mapInArrow(partial(_homes, tops=sent), pair), "homes")
    near = met(first, "first")
    reached = _best(near, nearest + 1).filter(F.col("n") == nearest + 1).select("uid", F.col("score").alias("known"))
    rest = queries.join(first.select("uid", "region"), "uid").join(reached, "uid", "left").mapInArrow(partial(_others, tops=sent, factor=factor), pair)
    near = near.unionByName(met(rest, "rest"))
    lists = _best(near, nearest + 1).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("near"))
    out = asked.join(lists, "uid").select("query_id", F.posexplode(F.expr(f"slice(filter(near, x -> x.id != query_id), 1, {nearest})")).alias("k", "x"))
    return out.select("query_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))


def op4_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP4_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(range(1, len(q.v) + 1), lambda k: q.v[k] * c.v[k])), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
