"""Token ids in a content-addressed store: packs of unique chunks, document recipes, Merkle roots.

Writing. Each task encodes its documents, cuts every id stream where a rolling hash of the last ids says
so (so equal passages give equal chunks wherever they stand), addresses a chunk by the SHA-256 of its
ids and writes chunks new to the task into blocks of a staging pack. Of the copies that several tasks
hold, the first by (pack, block, place) is kept: the packs are streamed once more into the store's packs,
which hold each chunk once. Recipes (document, start, chunk addresses, Merkle root) are stored in
ascending doc_id order, dealt by range.

Reading. Packs are streamed block by block; each chunk's address is computed again from its ids. Recipes
meet the chunks by that computed address, so a damaged chunk is missed and the read fails; a document's
CRC comes from its chunks' CRCs, shifted by the bytes that follow them.

Pack format: the line `TSPK2`, a byte that says how many bytes an id has (2 or 4), then blocks: u32 bytes stored, u32 bytes unpacked, u32 chunks, and LZ4 data
of the chunks' u32 lengths in bytes and then their ids; all little-endian. Files are named by task attempt, and only
committed attempts are listed, so a lost executor or a second attempt leaves files that nothing refers to. Packs hold
chunks in the order in which they were staged, as equal chunks of many documents are stored once; the recipes are what
is written in ascending doc_id order.

Defined cases: a null text is empty, so its stream is the end id alone; equal doc_ids are kept apart, in
the order of their streams' addresses; a very long text is one stream of ids, cut into chunks like any other;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, gapless, mix, table, window_hashes
from .tokens import encoded, encoder, tokenizer_path

MAGIC = b"TSPK2\n"
#: Ids in the rolling window, least and most ids of a chunk, and the hash bits that make a cut (mean about 2**bits).
WINDOW, LEAST, MOST, BITS = 8, 64, 4096, 9
#: Words in a worker's table while it stages: it holds little else then.
ENTRIES = 600_000
#: Bytes of ids in a block, and of a pack before the next one begins.
BLOCK, PACK = 1 << 18, 1 << 28

_STAGED = "doc_id long, n_tokens long, root binary, addresses array<binary>, after array<long>, new array<struct<address: binary, pack: string, block: long, place: int, n: int>>"


def merkle(addresses: list[bytes]) -> bytes:
    """The root over a document's chunk addresses; a lone one is carried up."""
    level = addresses
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[k : k + 2])).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends of windows whose rolling hash makes a cut, over many streams one after another.

    A window that reaches back into the stream before ends within LEAST ids of its start, where no cut is made.
    """
    if len(ids) < WINDOW:
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(window_hashes(mix(ids.astype(np.uint64)), WINDOW) >> np.uint64(64 - BITS) == 0) + WINDOW


def cuts(n: int, hits: list[int]) -> list[int]:
    """Ends of the chunks of one id stream of n ids, given its marks."""
    out, at, k = [], 0, 0
    while n - at > LEAST:
        while k < len(hits) and hits[k] < at + LEAST:
            k += 1
        at = min(hits[k] if k < len(hits) else n, at + MOST, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


class PackWriter:
    """Appends chunks to block-compressed packs under a folder; tells where each one is."""

    def __init__(self, folder: str, item: int):
        from pyarrow import fs

        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.head = MAGIC + bytes([item])
        self.codec, self.out, self.buffer, self.held = pa.Codec("lz4_raw"), None, [], 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.files.create_dir(self.folder, recursive=True)
            self.name = f"{uuid.uuid4().hex}.pack"
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}")
            self.out.write(self.head)
            self.at = len(self.head)
        where = (self.name, self.at, self.held)
        self.buffer.append(data)
        self.held += len(data)
        if self.held >= BLOCK:
            self._flush()
            if self.at >= PACK:
                self.close()
        return where

    def _flush(self) -> None:
        if self.held:
            raw = np.array([len(x) for x in self.buffer], dtype="<u4").tobytes() + b"".join(self.buffer)
            data = self.codec.compress(raw, asbytes=True)
            self.out.write(np.array([len(data), len(raw), len(self.buffer)], dtype="<u4").tobytes() + data)
            self.at += 12 + len(data)
        self.buffer, self.held = [], 0

    def close(self) -> None:
        if self.out is not None:
            self._flush()
            self.out.close()
            self.out = None


def blocks(folder: str, name: str):
    """A pack's blocks, one at a time: where each begins, bytes of an id, its chunks' lengths in bytes, its ids' bytes."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    codec = pa.Codec("lz4_raw")
    with files.open_input_stream(f"{path}/{name}") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"not a pack: {name}")
        item = f.read(1)[0]
        at = len(MAGIC) + 1
        while head := f.read(12):
            stored, size, n = np.frombuffer(head, dtype="<u4").tolist()
            raw = codec.decompress(f.read(stored), size, asbytes=True)
            yield at, item, np.frombuffer(raw, dtype="<u4", count=n), memoryview(raw)[4 * n :]
            at += 12 + stored


def _stage(batches, path: str, end: int, folder: str):
    dtype = encoder(path).dtype
    writer, seen = PackWriter(folder, dtype.itemsize), set()
    for docs, streams in encoded(batches, path, end, entries=ENTRIES):
        rows = []
        ends = np.cumsum([len(x) for x in streams])
        hits = marks(np.concatenate(streams))
        edges = np.searchsorted(hits, np.concatenate([[0], ends]), side="right")
        for k, (doc, ids) in enumerate(zip(docs, streams, strict=True)):
            own = (hits[edges[k] : edges[k + 1]] - (ends[k] - len(ids))).tolist()
            data, at, addresses, after, new = ids.astype(dtype).tobytes(), 0, [], [], []
            for stop in cuts(len(ids), own):
                chunk = data[at * dtype.itemsize : stop * dtype.itemsize]
                address = hashlib.sha256(chunk).digest()
                addresses.append(address)
                after.append(len(ids) - stop)
                if address not in seen:
                    seen.add(address)
                    pack, block, place = writer.add(chunk)
                    new.append({"address": address, "pack": pack, "block": block, "place": place, "n": stop - at})
                at = stop
            rows.append((doc, len(ids), merkle(addresses), addresses, after, new))
        columns = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.struct([("address", pa.binary()), ("pack", pa.string()), ("block", pa.int64()), ("place", pa.int32()), ("n", pa.int32())]))]
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_tokens", "root", "addresses", "after", "new"])
    writer.close()


def _compact(batches, source: str, target: str, item: int):
    """Rows (pack, block, place, n) of the chunks to keep, sorted: their bytes go on to new packs."""
    writer, kept, now, at, reader, data = PackWriter(target, item), {}, None, -1, None, b""
    for batch in batches:
        for pack, block, place, n in zip(*(batch.column(c).to_pylist() for c in ("pack", "block", "place", "n")), strict=True):
            if pack != now:
                now, at, reader = pack, -1, blocks(source, pack)
            while at < block:
                at, _, _, data = next(reader)
            name, _, _ = writer.add(data[place : place + n * item])
            kept[name] = kept.get(name, 0) + 1
    writer.close()
    yield pa.record_batch([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["pack", "chunks"])


def write_store(spark: SparkSession, docs: DataFrame, folder: str | None = None, end: int = 2, tokenizer: str | None = None) -> str:
    """Writes the store and returns its folder, which holds packs/, index (rows pack, chunks) and recipes."""
    arrow_batches(spark)
    scratch = Scratch(spark, "token-store")
    folder = folder or scratch.path("store")
    path = tokenizer or tokenizer_path()
    item = encoder(path).dtype.itemsize
    staged = scratch.write(docs.select("doc_id", "text").mapInArrow(partial(_stage, path=path, end=end, folder=scratch.path("staged-packs")), _STAGED), "staged")
    # one place for each address: the first
    found = staged.select(F.explode("new").alias("c")).select("c.*")
    first = found.groupBy("address").agg(F.min(F.struct("pack", "block", "place", "n")).alias("c")).select("c.*")
    keep = first.repartition("pack").sortWithinPartitions("pack", "block", "place")
    keep.mapInArrow(partial(_compact, source=scratch.path("staged-packs"), target=f"{folder}/packs", item=item), "pack string, chunks long").write.parquet(f"{folder}/index")
    scratch.drop("staged-packs")
    # recipes in ascending doc_id order, and where each document starts
    light = staged.select("doc_id", "n_tokens", "root", "addresses", "after")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.write(light.repartitionByRange(parts, "doc_id", "root").sortWithinPartitions("doc_id", "root").withColumn("pid", F.spark_partition_id()), "dealt")
    gapless(scratch, dealt, [], ["doc_id", "root"], "start", weight="n_tokens").drop("pid").write.parquet(f"{folder}/recipes")
    scratch.drop("staged", "dealt")
    return folder


def _chunks(batches, folder: str):
    """Pack names to their chunks: address and CRC, both computed from the ids as read."""
    for batch in batches:
        for name in batch.column("pack").to_pylist():
            for _, item, lengths, data in blocks(folder, name):
                at, address, n, crc = 0, [], [], []
                for size in lengths.tolist():
                    chunk = data[at : at + size]
                    address.append(hashlib.sha256(chunk).digest())
                    n.append(size // item)
                    crc.append(zlib.crc32(np.frombuffer(chunk, dtype=f"<u{item}").astype("<u4").tobytes()))
                    at += size
                yield pa.record_batch([pa.array(address, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["address", "n", "crc"])


def _recipes(batches):
    """Recipes to a row for each chunk, once the Merkle root holds."""
    for batch in batches:
        addresses = batch.column("addresses").to_pylist()
        for found, root in zip(addresses, batch.column("root").to_pylist(), strict=True):
            if merkle(found) != root:
                raise ValueError("a recipe's Merkle root does not hold")
        times = pa.array([len(x) for x in addresses], pa.int64())
        row = np.repeat(np.arange(batch.num_rows), times.to_numpy())
        yield pa.record_batch([batch.column("doc_id").take(pa.array(row)), batch.column("start").take(pa.array(row)), pa.array([x for found in addresses for x in found], pa.binary()), batch.column("after").flatten()], names=["doc_id", "start", "address", "after"])


@cache
def _powers() -> list[np.ndarray]:
    """For each k the columns of "2**k zero bytes follow" on a CRC-32 register (reflected polynomial)."""
    one = np.zeros(32, dtype=np.uint32)  # one zero bit follows
    one[0] = 0xEDB88320
    one[1:] = np.uint32(1) << np.arange(31, dtype=np.uint32)
    out, m = [], one
    for k in range(64):
        if k >= 3:
            out.append(m)
        m = _times(m, m)
    return out


def _times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for bit in range(32):
        out ^= np.where(v >> np.uint32(bit) & np.uint32(1), m[bit], np.uint32(0))
    return out


def shifted(crc: np.ndarray, following: np.ndarray) -> np.ndarray:
    """What a CRC-32 adds to that of the whole when so many bytes follow it; the whole is the XOR of these."""
    out, left, k, powers = crc.astype(np.uint32), following.astype(np.int64), 0, _powers()
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _times(powers[k], out[odd])
        left, k = left >> 1, k + 1
    return out


def _shift(batches):
    for batch in batches:
        add = shifted(batch.column("crc").to_numpy(), batch.column("after").to_numpy() * 4)
        yield pa.record_batch([batch.column("doc_id"), batch.column("start"), batch.column("n"), pa.array(add.astype(np.int64))], names=["doc_id", "start", "n", "crc"])


def _packs(spark: SparkSession, folder: str) -> DataFrame:
    """The packs listed, one to a task."""
    listed = spark.read.parquet(f"{folder}/index").groupBy("pack").agg(F.sum("chunks").alias("chunks"))
    return listed.select("pack").repartitionByRange(max(1, listed.count()), "pack")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document as the files hold it: doc_id, start, n_tokens, ids_crc32."""
    arrow_batches(spark, 20_000)
    chunks = _packs(spark, folder).mapInArrow(partial(_chunks, folder=f"{folder}/packs"), "address binary, n long, crc long")
    recipes = spark.read.parquet(f"{folder}/recipes").select("doc_id", "start", "root", "addresses", "after")
    used = recipes.mapInArrow(_recipes, "doc_id long, start long, address binary, after long").join(chunks.hint("merge"), "address", "left")  # its size is not known beforehand
    lost = F.raise_error(F.lit("a chunk of the store is missing or damaged")).cast("long")
    used = used.select("doc_id", "start", "after", F.when(F.col("crc").isNull(), lost).otherwise(F.col("crc")).alias("crc"), "n")
    parts = used.mapInArrow(_shift, "doc_id long, start long, n long, crc long")
    return parts.groupBy("doc_id", "start").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The store's documents with their ids: doc_id, start, ids (binary, as wide as the packs say)."""

    def load(batches, packs=f"{folder}/packs"):
        for batch in batches:
            for name in batch.column("pack").to_pylist():
                for _, _, lengths, data in blocks(packs, name):
                    ends = np.cumsum(lengths).tolist()
                    parts = [bytes(data[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                    yield pa.record_batch([pa.array([hashlib.sha256(x).digest() for x in parts], pa.binary()), pa.array(parts, pa.binary())], names=["address", "data"])

    chunks = _packs(spark, folder).mapInArrow(load, "address binary, data binary")
    recipes = spark.read.parquet(f"{folder}/recipes").select("doc_id", "start", "root", "addresses", "after")
    used = recipes.mapInArrow(_recipes, "doc_id long, start long, address binary, after long").join(chunks.hint("merge"), "address", "left")
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("after")).alias("k"), "data"))), lambda x: x["data"])
    return used.groupBy("doc_id", "start").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))


def op10_content_addressed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_store(spark, table(spark, sf_dir, "documents"))
    return read_store(spark, folder)
