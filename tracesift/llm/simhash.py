"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into distance // 2 + 1 segments, so of two fingerprints that differ in at most
`distance` bits one segment differs in at most one. Every segment is indexed once for each of its bits with
that bit left out: two segments that differ in at most one bit share such a variant. Rows that share a
variant meet by an equality shuffle, and the whole fingerprints are compared there, a bucket at a time.

Only distinct fingerprints are indexed, so exact copies cost nothing, and a bucket passes on the edges of a
spanning forest of the links it found, never its pairs: at most one row for each that came in. A segment
value so frequent that its buckets would pass `bucket` rows has them cut into blocks, and each two blocks
meet in a task of their own: whole, and bounded.

Defined cases: a text without words, or null, has fingerprint zero, and is linked like any other; fewer words
than a shingle make one shingle; repeated rows share a component; a component all of whose doc_ids are null
has component_id null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, possibly, table, text_key
from .components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Most rows of a bucket that one task compares; larger ones are cut into blocks.
BUCKET = 50_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED, piece: int = 1 << 16) -> int:
    """The SimHash of a text's word shingles, repeats included, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    text = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    ends = ends[-n:]
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, piece):
        h = np.array([xxh64_intdigest(text[i:j], seed) for i, j in zip(starts[a : a + piece].tolist(), ends[a : a + piece].tolist(), strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches, shingle: int):
    for batch in batches:
        fps = np.array([fingerprint(t.as_py() or b"", shingle) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.record_batch([*(batch.column(c) for c in names), pa.array(fps)], names=[*names, "fp"])


def segments(distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, width) of each."""
    n = distance // 2 + 1
    edges = [-(-bits * k // n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _value(fp: str, first: int, width: int) -> str:
    return f"(shiftrightunsigned({fp}, {first}) & {(1 << width) - 1}L)"


def variants(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(key, fp): a row for each one-wildcard variant of each segment; keys of frequent values are cut into blocks."""
    cut = segments(distance)
    values = fps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("segment"), F.expr(_value("fp", *s)).alias("value")) for k, s in enumerate(cut)])).alias("s")).select("s.*")
    frequent = values.groupBy("segment", "value").count().filter(F.col("count") > bucket // 2)

    def keys(segment: str | None, value) -> list:
        out = []
        for k, (first, width) in enumerate(cut):
            for bit in range(width):
                v = value(first, width)
                key = f"{(first + bit) << 40}L + ({v} & {~(1 << bit)}L)"
                out.append(key if segment is None else f"CASE WHEN {segment} = {k} THEN {key} END")
        return out

    hot = frequent.select("count", F.explode(F.expr(f"array({', '.join(keys('segment', lambda *_: 'value'))})")).alias("key")).filter("key IS NOT NULL")
    hot = hot.groupBy("key").agg((F.sum("count") * 2 / bucket + 1).cast("int").alias("blocks"))
    rows = fps.select("fp", F.explode(F.expr(f"array({', '.join(keys(None, lambda first, width: _value('fp', first, width)))})")).alias("key"))
    # the hint decides the side: Spark takes the 64 rows a fingerprint for one, and would broadcast them. `hot` has fewer than a row for bucket / 128 fingerprints
    rows = rows.join(F.broadcast(hot), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    plain = rows.filter("blocks = 1").select("key", "fp")
    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    cut_up = rows.filter("blocks > 1").select("key", "fp", F.expr("pmod(xxhash64(fp), blocks)").cast("int").alias("own"), other)
    cut_up = cut_up.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"), F.lit("blocks")).alias("key"), "fp")
    return plain.unionByName(cut_up)


def linked(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (positions, roots) among sorted rows: those of one key that differ in few enough bits."""
    n, left, right = len(keys), [], []
    at, d = np.arange(n, dtype=np.int64), 0
    while len(at):
        d += 1
        at = at[: np.searchsorted(at, n - d)]
        at = at[keys[at] == keys[at + d]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= distance]
        left.append(near)
        right.append(near + d)
    label = np.arange(n, dtype=np.int64)
    if left:
        i, j = np.concatenate(left), np.concatenate(right)
        while True:
            least = np.minimum(label[i], label[j])
            if (least == label[i]).all() and (least == label[j]).all():
                break
            np.minimum.at(label, i, least)
            np.minimum.at(label, j, least)
            label = label[label]
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def _edges(batches, distance: int):
    """Rows sorted by key; a key's rows are compared once the next key is seen."""
    keys, fps = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

    def out(keys, fps):
        a, b = linked(keys, fps, distance)
        return pa.record_batch([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["u", "v"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
        if len(keys):
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole:
                yield out(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
    yield out(keys, fps)


def grouped(scratch: Scratch, docs: DataFrame, columns: str, distance: int = DISTANCE, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """The given columns of every document (as DDL; `doc_id long` among them), fp, component (its least fp) and component_id."""
    spark = scratch.spark
    arrow_batches(spark)
    names = [c.split()[0] for c in columns.split(", ")]
    found = docs.select(*names, F.col("text").cast("binary").alias("text")).mapInArrow(partial(_fingerprints, shingle=shingle), f"{columns}, fp long")
    found = scratch.write(found, "fingerprints")
    fps = scratch.write(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    rows = variants(fps.select("fp"), distance, bucket).repartition("key").sortWithinPartitions("key")
    arrow_batches(spark, 100_000)
    links = scratch.write(rows.mapInArrow(partial(_edges, distance=distance), "u long, v long").distinct(), "links")
    arrow_batches(spark)
    parts = components(scratch, links).withColumnRenamed("node", "fp")
    # the least doc_id of each component, then of every fingerprint
    joined = parts.join(fps, "fp")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = parts.join(least, "component").select("fp", "component", "component_id")
    alone = F.col("component").isNull()
    of = scratch.write(fps.join(named, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.when(alone, F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "classes")
    return found.join(of, "fp")


def near_duplicates(spark: SparkSession, docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    rows = grouped(Scratch(spark, "simhash"), docs, "doc_id long", distance, shingle, bucket)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of(scratch: Scratch, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each component in `rows` (doc_id, key, component) the document with the smallest doc_id (then text key), with all its columns.

    Documents alone in their component pass without a shuffle; only those that may be in a larger one meet what is kept.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key"))
    named = scratch.write(rows.groupBy("component").agg(first.alias("x"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("component", "x"), "groups")
    kept = scratch.write(named.select(F.xxhash64("x.key", "x.doc_id").alias("_pick"), F.col("x.key").alias("_key")), "kept")
    grouped_rows = scratch.write(rows.join(named.select("component"), "component", "left_semi").select(F.xxhash64("key", "doc_id").alias("pick")), "picks")
    # all columns in one, so that none of theirs clashes with those made here
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key().alias("_key"), F.xxhash64(text_key(), "doc_id").alias("_pick"))
    met, alone = possibly(keyed, F.col("_pick"), grouped_rows)
    # the few that share a bit with a document of a group are alone as well: told apart by the picks themselves
    of_group = grouped_rows.distinct().withColumnRenamed("pick", "_pick")
    alone = alone.unionByName(met.join(of_group, "_pick", "left_anti"))
    return alone.select("row.*").unionByName(met.join(kept, ["_pick", "_key"], "left_semi").dropDuplicates(["_pick", "_key"]).select("row.*"))


def keep_one(spark: SparkSession, docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """Of each component the document with the smallest doc_id (then text key), with all its columns."""
    scratch = Scratch(spark, "simhash")
    return first_of(scratch, docs, grouped(scratch, docs.select("doc_id", "text", text_key().alias("key")), "doc_id long, key binary", distance, shingle))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))
