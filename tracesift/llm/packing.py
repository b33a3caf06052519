"""Best-fit packing by the configuration linear program of the length histogram.

Only the histogram (a row for each length up to the capacity) reaches the driver. The covering program
"fewest sequences so that each length is packed as often as it occurs" is solved by multiplicative
weights: each round takes the length covered least, a knapsack dynamic program over the lengths' prices
finds the configuration worth most beside it, and the prices of what it packs fall. The fractional solution is rounded down; what is left is packed by
configurations that hold the longest length left and fill the rest best, each used as often as the
counts allow, so a few thousand of them finish any number of pieces. Pieces get a gapless rank in their
length, and the plan says where each rank goes.

Defined cases: a null text is empty, so its document is the end id alone; repeated rows and equal doc_ids
are packed one by one; pieces of equal length are ranked by doc_id, piece and checksum, and those equal in all are
alike; a very long text is cut into pieces; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, gapless, give_back, table
from .tokens import CACHE_ENTRIES, encoded, tokenizer_path

#: Sweeps of multiplicative weights over the lengths, lengths priced in a knapsack, how fast prices fall, and the power of its length with which a price begins.
SWEEPS, PRICED, FALL, POWER = 4, 48, 0.25, 1.01

#: Parts in which the pieces of one length are ranked.
DEALS = 128

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def _cut(batches, path: str, end: int, capacity: int, entries: int = CACHE_ENTRIES):
    """The pieces of each document: all of `capacity` but the first, which holds what is left over."""
    for docs, ids in encoded(batches, path, end, entries=entries):
        out = [[], [], [], [], []]
        for doc, x in zip(docs, ids, strict=True):
            at = 0
            size = (len(x) - 1) % capacity + 1
            for piece in range(-(-len(x) // capacity)):
                part = x[at : at + size]
                for column, value in zip(out, (doc, piece, at, size, zlib.crc32(part.tobytes())), strict=True):
                    column.append(value)
                at, size = at + size, capacity
        yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
    give_back()


def _knapsack(price: np.ndarray, sizes: np.ndarray, copies: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of sizes worth most that fits the room."""
    best, taken = np.zeros(room + 1), []
    for size, n in zip(sizes.tolist(), copies.tolist(), strict=True):
        n, bundle = min(n, room // size), 1
        while n > 0:  # bundles of 1, 2, 4, ... copies
            bundle = min(bundle, n)
            taken_size = bundle * size
            new = best[: room + 1 - taken_size] + bundle * price[size]
            better = new > best[taken_size:]
            if better.any():
                np.maximum(best[taken_size:], new, out=best[taken_size:])
                taken.append((size, bundle, better))
            n, bundle = n - bundle, 2 * bundle
    w, out = room, {}
    for size, bundle, better in reversed(taken):
        if w >= size * bundle and better[w - size * bundle]:
            out[size] = out.get(size, 0) + bundle
            w -= size * bundle
    return out


def _configuration(must: int, left: np.ndarray, worth: np.ndarray, capacity: int) -> dict[int, int]:
    """One piece of length `must` and what is worth most beside it, among the longest that fit, the dearest, and some of all lengths."""
    spare = left.copy()
    spare[must] -= 1
    room = capacity - must
    fit = np.flatnonzero(spare[: room + 1])
    if len(fit) > PRICED:
        third = PRICED // 3
        dear = fit[np.argsort(-(worth[fit] / fit), kind="stable")[:third]]
        spread = fit[np.linspace(0, len(fit) - 1, third).astype(int)]
        fit = np.unique(np.concatenate([fit[-third:], dear, spread]))
    fit = fit[::-1]
    config = _knapsack(worth, fit, spare[fit], room)
    config[must] = config.get(must, 0) + 1
    return config


def solve(histogram: dict[int, int], capacity: int, sweeps: int = SWEEPS) -> list[tuple[dict[int, int], int]]:
    """Configurations (length -> copies) and how often each is used; together they pack every piece once."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        count[length] = n
    plan: list[tuple[dict[int, int], int]] = []
    if count[capacity]:
        plan.append(({capacity: 1}, int(count[capacity])))
        count[capacity] = 0
    lengths = np.flatnonzero(count)
    total = count[lengths].astype(float)
    size = np.arange(capacity + 1, dtype=float)
    # multiplicative weights over the covering constraints: the price of a length falls as it is covered
    weight = np.ones(capacity + 1)
    covered = np.zeros(capacity + 1)
    used: dict[tuple, float] = {}
    while len(lengths) and (share := covered[lengths] / total).min() < 1 - 0.5 / sweeps:
        must = int(lengths[len(lengths) - 1 - np.argmin(share[::-1])])
        config = _configuration(must, count, size**POWER * weight, capacity)
        ls, ns = np.array(list(config)), np.array(list(config.values()))
        amount = float((count[ls] / ns).min()) / sweeps
        key = tuple(sorted(config.items()))
        used[key] = used.get(key, 0.0) + amount
        covered[ls] += ns * amount
        weight[ls] *= np.exp(-FALL * ns * amount / count[ls])
    # rounding: whole uses only, and never more pieces than there are
    for key, amount in sorted(used.items(), key=lambda x: (-x[0][-1][0], -x[1], x[0])):
        times = min([int(amount), *(int(count[x] // n) for x, n in key)])
        if times > 0:
            plan.append((dict(key), times))
            for x, n in key:
                count[x] -= n * times
    # the rest: the longest left, and what fills its sequence best
    while (left := np.flatnonzero(count)).size:
        config = _configuration(int(left[-1]), count, size * (1 + 1e-6 * size), capacity)
        times = min(int(count[x] // n) for x, n in config.items())
        plan.append((config, times))
        for x, n in config.items():
            count[x] -= n * times
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, copies in a sequence, first offset), by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for config, times in plan:
        offset = 0
        for length, n in sorted(config.items(), reverse=True):
            first = rank.get(length, 0)
            rows.setdefault(length, []).append((first, sequence, n, offset))
            rank[length] = first + n * times
            offset += n * length
        sequence += times
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def _place(batches, slots: dict[int, np.ndarray]):
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            size = int(length[at[0]])
            rows = slots[size]
            row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
            within = rank[at] - row[:, 0]
            sequence[at] = row[:, 1] + within // row[:, 2]
            offset[at] = row[:, 3] + within % row[:, 2] * size
        yield pa.record_batch([*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(spark: SparkSession, docs: DataFrame, capacity: int = 2048, end: int = 0, tokenizer: str | None = None, entries: int = CACHE_ENTRIES) -> DataFrame:
    """A row for each piece: where it starts in its document, and its sequence and place there.

    `entries` bounds the table of encoded words that a Python worker keeps.
    """
    arrow_batches(spark)
    scratch = Scratch(spark, "packing")
    cut = docs.select("doc_id", "text").mapInArrow(partial(_cut, path=tokenizer or tokenizer_path(), end=end, capacity=capacity, entries=entries), _PIECES)
    pieces = scratch.write(cut.withColumn("pid", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(DEALS)).cast("int")), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length, `capacity` at most
    slots = _slots(solve(histogram, capacity))
    ranked = gapless(scratch, pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", few=True)  # capacity * DEALS rows at most
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(partial(_place, slots=slots), _PIECES + ", sequence_id long, offset long")


def op9_configuration_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack(spark, table(spark, sf_dir, "documents"))
    return rows.withColumn("length", F.col("length").cast("long"))
