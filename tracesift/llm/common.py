"""What the training-data operators share: scratch tables, stable ranks, word hashing.

Nothing here collects rows; the only things that reach the driver are counts.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a Python worker gets at once; with texts of some KB this is a few MB.
BATCH_ROWS = 1000


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only where it is unset and all of Spark is one process is a temporary folder made and set; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracesift-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage, each readable after any executor is lost."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        for name in names:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps the Arrow batches sent to Python workers small, whatever a row's size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_key() -> Column:
    """16 bytes that name a text: equal for equal texts only; null counts as its own text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.when(F.col("text").isNull(), "0").otherwise("1"), F.coalesce("text", F.lit(""))), 256), 1, 32))


#: Bits of a bitmap, and bitmaps of a filter: 8 million bits, 1 MB, whatever the table's size.
_BITMAP, _BITMAPS = 32_768, 256


def possibly(rows: DataFrame, pick: Column, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` whose `pick` (long) may be among `picks` (a column `pick`), and those whose pick is surely not, without a shuffle.

    A bit for each hashed pick is broadcast: 1 MB at any size. Where picks are very many, more rows are possible ones.
    """
    slot = lambda p: F.pmod(F.xxhash64(p, F.lit(7)), F.lit(_BITMAP * _BITMAPS))
    at = picks.select(slot(F.col("pick")).alias("at"))
    maps = at.groupBy((F.col("at") / _BITMAP).cast("int").alias("_map")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(_BITMAP))).alias("_bits"))
    named = rows.withColumn("_at", slot(pick)).withColumn("_map", (F.col("_at") / _BITMAP).cast("int"))
    met = named.join(F.broadcast(maps), "_map", "left")
    byte = F.expr(f"cast(conv(hex(substring(_bits, cast(pmod(_at, {_BITMAP}) div 8 AS int) + 1, 1)), 16, 10) AS int)")
    seen = F.coalesce((byte / F.pow(F.lit(2), F.pmod("_at", F.lit(8)))).cast("int") % 2 == 1, F.lit(False))
    met = met.withColumn("_seen", seen).drop("_at", "_map", "_bits")
    return met.filter("_seen").drop("_seen"), met.filter("NOT _seen").drop("_seen")


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def gapless(scratch: Scratch, df: DataFrame, group: list[str], order: list[str], out: str, weight: str | None = None, few: bool = False) -> DataFrame:
    """Adds `out`: a gapless rank from 0 within `group`, or with `weight` the sum of the weights before.

    `df` must be a stored table with a column `pid`, any deal of its rows. Each (group, pid) is ranked
    by itself and moved by what the smaller pids hold, so no group has to meet in one task. `few` says that there is
    a bound on the pairs of group and pid, small enough to be broadcast.
    """
    from pyspark.sql import Window

    amount = F.col(weight) if weight else F.lit(1)
    total = scratch.write(df.groupBy(*group, "pid").agg(F.sum(amount).cast("long").alias("_n")), f"totals-{out}")
    before = Window.partitionBy(*group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    start = total.select(*[F.col(c).alias(f"_{c}") for c in [*group, "pid"]], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "pid").orderBy(*order)
    own = (F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - amount) if weight else F.row_number().over(inside) - 1
    ranked = df.withColumn("_own", own.cast("long"))
    same = [ranked[c].eqNullSafe(start[f"_{c}"]) for c in [*group, "pid"]]
    # without a bound on the groups and deals no broadcast; `ranked` is dealt by these columns already
    joined = ranked.join(F.broadcast(start) if few else start.hint("merge"), on=[x for x in same], how="inner")
    return joined.withColumn(out, F.col("_start") + F.col("_own")).drop("_own", "_start", *[f"_{c}" for c in [*group, "pid"]])


# --- word hashing over whole Arrow batches -------------------------------------------------------

_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def byte_class(separators: bytes) -> np.ndarray:
    """A table: is this byte part of a word."""
    t = np.ones(256, dtype=bool)
    t[np.frombuffer(separators, dtype=np.uint8)] = False
    return t


#: Word bytes for `[^\x20\x09-\x0D]+`.
NOT_SPACE = byte_class(b" \t\n\x0b\x0c\r")


def word_spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes for which `inside` holds."""
    m = np.empty(len(data) + 2, dtype=bool)
    m[0] = m[-1] = False
    np.take(inside, data, out=m[1:-1])
    edges = np.flatnonzero(m[1:] != m[:-1])
    return edges[0::2], edges[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans are handled some at a time to bound memory."""
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    lens = ends - starts
    power = np.ones(int(lens.max()), dtype=np.uint64)
    if len(power) > 1:
        power[1:] = _BASE
        np.multiply.accumulate(power, out=power)
    for a in range(0, len(starts), piece):
        b = min(a + piece, len(starts))
        n = lens[a:b]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        values = _TABLE[data[np.repeat(starts[a:b], n) + within]] * power[within]
        out[a:b] = np.add.reduceat(values, first) + n.astype(np.uint64) * _STEP
    return mix(out)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _BASE + right)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` words, by doubling; one for each start, fewer words: none."""
    if len(words) < length:
        return np.empty(0, dtype=np.uint64)
    if length == 1:
        return words
    half = (length + 1) // 2
    h = window_hashes(words, half)
    return pair_hash(h[: len(words) - length + 1], h[length - half :][: len(words) - length + 1])


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` neighbours, by doubling."""
    if span == 1:
        return values
    half = (span + 1) // 2
    m = sliding_min(values, half)
    n = len(values) - span + 1
    return np.minimum(m[:n], m[span - half :][:n])


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def add_default_path() -> None:  # the tokenizer files are found beside Python's packages
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
