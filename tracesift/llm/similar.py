"""Near copies from a similarity on: SimHash with a signature wide enough to tell it, by deletion variants.

The signature has 512 bits over a text's distinct five-word shingles. Of two texts with Jaccard similarity s a bit
differs with a chance of acos(2s / (1 + s)) / pi or less, 0.15 at s = 0.8, so the share of differing bits tells the
similarity to about 0.035 (one standard error). Candidates are pairs up to MARGIN standard errors beyond the share
expected at the least similarity.

The first 256 bits are cut into 16 segments, few enough that of candidates one differs in at most one bit (with a
chance of 0.994 at a similarity of 0.8, 0.9995 at 0.85), and segments are met by their variants with one bit left
out. A difference of one bit leaves one half of the segment equal: rows are dealt by that half, two for each segment
rather than one for each variant, and the variants of the other half are made and met where the rows are. All 512
bits are compared there. A task passes on a spanning forest of what it linked, never its pairs, and does not compare
rows that it has linked already, so a large group of near copies costs its size and not its square there.

Candidates make clusters, and within a cluster similarities are verified on the whole sets of shingles: each set is
sent once (a cluster of more than CLUSTER shingles is cut into blocks that meet two by two, so that no task holds
more than a bounded number), and only sets that are not linked yet are compared. What is verified makes the groups.

Equal signatures are indexed once, so exact copies cost nothing. A half that more than BUCKET signatures share has
its rows cut into blocks as well. At very large numbers of texts a half of eight bits is coarse: `segments` is a
parameter, and tasks grow in number, not in size.

Defined cases: texts without words, or null, have the empty signature and are linked to each other; fewer words
than a shingle make one shingle; very long texts are added up piece by piece; of documents equal in id and text one
is kept; an empty table gives an empty result; all columns are kept, whatever their names.
"""

from __future__ import annotations

from functools import partial
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, Scratch, arrow_batches, give_back, mix, possibly, span_hashes, text_key, window_hashes, word_spans
from .components import WHOLE, components
from .simhash import first_of

#: Words of a shingle, the least similarity as a fraction, standard errors beyond it that still make candidates.
SHINGLE, PARTS, OF, MARGIN = 5, 4, 5, 3.0
#: 64-bit words of a signature, and segments of 16 bits that are indexed.
WORDS, SEGMENTS = 8, 16
#: Signatures of one half that one task compares; a variant's rows above which they are compared one with the rest.
BUCKET, PAIRWISE = 50_000, 48
#: Rows a task gathers, of whole halves, before it compares; shingles of a block of a cluster.
GATHER, CLUSTER = 25_000, 1 << 18
_SALTS = np.random.Generator(np.random.PCG64(51966)).integers(1, 2**63, size=WORDS + 2, dtype=np.uint64)


def limit(similarity: float = PARTS / OF, margin: float = MARGIN, bits: int = 64 * WORDS) -> int:
    """Differing bits up to which two signatures are candidates."""
    share = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
    return int(bits * share + margin * sqrt(bits * share * (1 - share)))


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's word shingles, each once."""
    data = np.frombuffer(text.lower(), dtype=np.uint8)
    starts, ends = word_spans(data, NOT_SPACE)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    return np.unique(window_hashes(span_hashes(data, starts, ends), min(shingle, len(starts))))


def signature(text: bytes, shingle: int = SHINGLE, piece: int = 1 << 13) -> np.ndarray:
    """WORDS unsigned 64-bit numbers: a bit is 1 where over half of the distinct shingles' hashes have it."""
    s = shingles(text, shingle)
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    for a in range(0, len(s), piece):
        h = mix(s[a : a + piece, None] ^ _SALTS[None, :WORDS])
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(s), bitorder="little").view("<u8")


def names(signatures: np.ndarray) -> pa.Array:
    """16 bytes that name each signature."""
    out = np.empty((len(signatures), 2), dtype=np.uint64)
    for k in range(2):
        h = np.full(len(signatures), _SALTS[WORDS + k], dtype=np.uint64)
        for w in range(signatures.shape[1]):
            h = mix(h ^ signatures[:, w])
        out[:, k] = h
    return pa.Array.from_buffers(pa.binary(16), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


_COLUMNS = [f"w{k}" for k in range(WORDS)]
_SIGNED = f"doc_id long, key binary, node binary, {', '.join(f'{c} long' for c in _COLUMNS)}"


def _signed(batches, shingle: int):
    for batch in batches:
        if not batch.num_rows:
            continue
        made = np.stack([signature(t.as_py() or b"", shingle) for t in batch.column("text")])
        words = [pa.array(made[:, k].copy().view(np.int64)) for k in range(WORDS)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("key"), names(made), *words], names=["doc_id", "key", "node", *_COLUMNS])
    give_back()


def halves(distinct: DataFrame, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """(key, words): a row for each half of each segment; the key's top byte numbers the half."""
    of = lambda j: F.expr(f"shiftleft({j}L, 56) | (shiftrightunsigned(w{j // 8}, {8 * (j % 8)}) & 255)")
    rows = distinct.select(F.explode(F.array(*map(of, range(2 * segments)))).alias("key"), *_COLUMNS)
    counts = rows.groupBy("key").count().filter(F.col("count") > bucket)  # a row for each value of each half at most
    hot = F.broadcast(counts.select("key", (F.col("count") * 2 / bucket + 1).cast("int").alias("blocks")))
    rows = rows.join(hot, "key", "left")
    plain = rows.filter("blocks IS NULL").select("key", *_COLUMNS)
    cut = rows.filter("blocks IS NOT NULL").withColumn("own", F.expr(f"cast(pmod(xxhash64({', '.join(_COLUMNS)}), blocks) AS int)"))
    cut = cut.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    pair = F.shiftrightunsigned(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")), 8)
    return plain.unionByName(cut.select(F.shiftleft(F.shiftright("key", 56), 56).bitwiseOR(pair).alias("key"), *_COLUMNS))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least position in the component of each."""
    label = np.arange(n, dtype=np.int64)
    while len(i):
        least = np.minimum(label[i], label[j])
        if (least == label[i]).all() and (least == label[j]).all():
            break
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
    return label


def _one_by_one(words: np.ndarray, rows: np.ndarray, label: np.ndarray, most: int, out: list[tuple[int, int]]) -> None:
    """Links among the rows of one variant, each against those not in its component yet."""
    label, alive = label.copy(), np.arange(len(rows))
    while len(alive) > 1:
        at, alive = alive[0], alive[1:]
        other = alive[label[alive] != label[at]]
        if not len(other):
            if (label[alive] == label[at]).all():
                break
            continue
        near = other[np.bitwise_count(words[rows[other]] ^ words[rows[at]]).sum(axis=1, dtype=np.int64) <= most]
        if len(near):
            found, first = np.unique(label[near], return_index=True)
            out.extend((int(rows[at]), int(rows[k])) for k in near[first])
            label[np.isin(label, found)] = label[at]


def linked(keys: np.ndarray, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (positions, roots) among rows sorted by key: those of a key whose other halves differ in at most one bit and whose signatures in few enough."""
    n = len(keys)
    place = (keys >> 56) ^ 1
    other = (words[np.arange(n), place // 8] >> (8 * (place % 8)).astype(np.uint64)) & np.uint64(255)
    group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
    variant = np.concatenate([(group * 8 + b) * 256 + (other & np.uint64(255 ^ 1 << b)).astype(np.int64) for b in range(8)])
    order = np.argsort(variant, kind="stable")
    variant, rows = variant[order], order % n
    edges = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1], [True]]))
    sizes = np.diff(edges)
    small = np.repeat(sizes <= PAIRWISE, sizes)
    at, d, left, right = np.flatnonzero(small), 0, [], []
    while len(at):
        d += 1
        at = at[at + d < len(variant)]
        at = at[variant[at] == variant[at + d]]
        i, j = rows[at], rows[at + d]
        new = (other[i] != other[j]) | ((variant[at] >> 8) % 8 == 0)  # equal halves meet in every variant: once is enough
        i, j = i[new], j[new]
        for a in range(0, len(i), 1 << 18):
            x, y = i[a : a + (1 << 18)], j[a : a + (1 << 18)]
            near = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) <= most
            left.append(x[near])
            right.append(y[near])
    i, j = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (left, right))
    label = _roots(n, i, j)
    for k in np.flatnonzero(sizes > PAIRWISE):
        more: list[tuple[int, int]] = []
        some = rows[edges[k] : edges[k + 1]]
        _one_by_one(words, some, label[some], most, more)
        if more:
            i, j = (np.concatenate([x, np.array(y, dtype=np.int64)]) for x, y in zip((i, j), zip(*more, strict=True), strict=True))
            label = _roots(n, i, j)
            i, j = np.flatnonzero(label != np.arange(n)), label[label != np.arange(n)]  # a spanning forest is enough
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def _whole_keys(batches, least: int):
    """Tables of whole keys, of at least so many rows where there are, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            whole = pa.Table.from_batches(held)
            keys = whole.column("key").to_numpy()
            cut = int(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[-1])  # where the last key begins
            if cut:
                yield whole.slice(0, cut)
            held = whole.slice(cut).combine_chunks().to_batches()
            n = len(keys) - cut
    if n:
        yield pa.Table.from_batches(held)


def _edges(batches, most: int):
    """Rows sorted by key to spanning edges; a key's rows are bounded by the blocks."""
    for table in _whole_keys(batches, GATHER):
        words = np.stack([table.column(c).to_numpy().view(np.uint64) for c in _COLUMNS], axis=1)
        a, b = linked(table.column("key").to_numpy(), words, most)
        yield pa.record_batch([names(words[a]), names(words[b])], names=["u", "v"])
    give_back()


def alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning edges among sets: those of the similarity, each set against those not linked to it yet."""
    sizes = np.array([len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # shingles of one set alone are in no intersection
    of = np.where(times > 1, shared, -1)[column]
    width = int((times > 1).sum())
    bits = np.zeros((len(sets), -(-max(1, width) // 64)), dtype=np.uint64)
    at = 0
    for k, n in enumerate(sizes.tolist()):
        row = np.zeros(64 * bits.shape[1], dtype=bool)
        row[of[at : at + n][of[at : at + n] >= 0]] = True
        bits[k] = np.packbits(row, bitorder="little").view("<u8")
        at += n
    out: list[tuple[int, int]] = []
    label, alive = np.arange(len(sets)), np.arange(len(sets))
    while len(alive) > 1:
        i, alive = alive[0], alive[1:]
        other = alive[label[alive] != label[i]]
        other = other[OF * np.minimum(sizes[other], sizes[i]) >= PARTS * np.maximum(sizes[other], sizes[i])]
        for a in range(0, len(other), 256):
            some = other[a : a + 256]
            both = np.bitwise_count(bits[some] & bits[i]).sum(axis=1, dtype=np.int64)
            near = some[(OF + PARTS) * both >= PARTS * (sizes[some] + sizes[i])]
            found, first = np.unique(label[near], return_index=True)
            out.extend((int(i), int(k)) for k in near[first])
            label[np.isin(label, found)] = label[i]
        if (label == label[i]).all():
            break
    return out


def _verified(batches):
    """Rows (key, node, shingles) sorted by key: spanning edges of the pairs of a key that have the similarity."""
    for table in _whole_keys(batches, 1000):
        keys, nodes, sets = table.column("key").to_numpy(), table.column("node").to_pylist(), table.column("shingles").combine_chunks()
        ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        edges, left, right = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])), [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                found = alike([flat[ends[k] : ends[k + 1]] for k in range(a, b)])
                left += [nodes[a + i] for i, _ in found]
                right += [nodes[a + j] for _, j in found]
        yield pa.record_batch([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["u", "v"])
    give_back()


def _sets(batches, shingle: int):
    for batch in batches:
        made = pa.array([shingles(t.as_py() or b"", shingle).view(np.int64) for t in batch.column("text")], pa.list_(pa.int64()))
        yield pa.record_batch([batch.column("node"), batch.column("cluster"), made], names=["node", "cluster", "shingles"])


def verified(scratch: Scratch, docs: DataFrame, signed: DataFrame, clusters: DataFrame, shingle: int = SHINGLE, block: int = CLUSTER) -> DataFrame:
    """Edges (u, v) of the nodes of a cluster (node, cluster) whose texts' shingles have the similarity."""
    spark = scratch.spark
    some = signed.join(clusters, "node").groupBy("node", "cluster").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")).alias("x"))
    some = scratch.write(some.select("node", "cluster", F.xxhash64("x.key", "x.doc_id").alias("pick"), F.col("x.key").alias("key")), "cluster-texts")
    keyed = docs.select(F.col("text").cast("binary").alias("text"), text_key().alias("key"), F.xxhash64(text_key(), "doc_id").alias("pick"))
    # most documents have no near copy: their texts are not shuffled
    texts = possibly(keyed, F.col("pick"), some.select("pick"))[0].join(some, ["pick", "key"]).select("node", "cluster", "text")
    sets = scratch.write(texts.mapInArrow(partial(_sets, shingle=shingle), "node binary, cluster binary, shingles array<long>").dropDuplicates(["node"]), "sets")
    sizes = sets.groupBy("cluster").agg(F.sum(F.size("shingles") + 1).alias("n")).filter(F.col("n") > block)
    large = scratch.write(sizes.select("cluster", F.ceil(2 * F.col("n") / block).cast("int").alias("blocks")), "large")
    rows = sets.join(large, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) AS int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.filter("blocks = 1 OR own <> other")  # two different blocks meet, and hold the pairs inside each as well
    key = F.when(F.col("blocks") == 1, F.xxhash64("cluster")).otherwise(F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")))
    dealt = rows.select(key.alias("key"), "node", "shingles").repartition("key").sortWithinPartitions("key")
    arrow_batches(spark, 200)
    return scratch.write(dealt.mapInArrow(_verified, "u binary, v binary").distinct(), "verified")


def grouped(scratch: Scratch, docs: DataFrame, shingle: int = SHINGLE, most: int | None = None, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, key (of the text) and component of every document."""
    spark = scratch.spark
    arrow_batches(spark)
    keyed = docs.select("doc_id", text_key().alias("key"), F.col("text").cast("binary").alias("text"))
    signed = scratch.write(keyed.mapInArrow(partial(_signed, shingle=shingle), _SIGNED), "signed")
    distinct = signed.groupBy("node", *_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
    distinct = scratch.write(distinct.select(*_COLUMNS), "distinct")
    rows = halves(distinct, segments, bucket).repartition("key").sortWithinPartitions("key")
    arrow_batches(spark, 50_000)
    links = scratch.write(rows.mapInArrow(partial(_edges, most=limit() if most is None else most), "u binary, v binary").distinct(), "links")
    arrow_batches(spark)
    clusters = scratch.write(components(scratch, links, "candidates", WHOLE).withColumnRenamed("component", "cluster"), "clusters")
    edges = verified(scratch, docs, signed, clusters, shingle)
    arrow_batches(spark)
    parts = components(scratch, edges, "stars", WHOLE).withColumnRenamed("node", "of")
    both = signed.select("doc_id", "key", "node").join(parts, F.col("node") == F.col("of"), "left")
    return both.select("doc_id", "key", F.coalesce("component", "node").alias("component"))


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, most: int | None = None) -> DataFrame:
    """Of each component the document with the smallest doc_id (then text key), with all its columns."""
    scratch = Scratch(spark, "similar")
    return first_of(scratch, docs, grouped(scratch, docs.select("doc_id", "text"), shingle, most))
