"""Substring dedup by level-wise doubling: long windows that repeat, found through shorter ones.

Window lengths double up to the one asked for (35 words: 9, 18, 35). On a level below the last, a window of
the final length is stood for by the least hash of the level's windows inside it, so equal windows are stood
for by equal hashes and only about one word in ten is sent on. A hash that occurs at one place only ends
every window it stands for; documents none of whose windows survive leave, and the others go on to the
next length, until the last level counts whole windows or no candidate is left. Windows equal at every
level are equal: hashes have 64 bits, and the last must agree along with those below it.

Equal texts are one class: its representative is scanned and counts as often as the class has rows.

Defined cases: a null or wordless text has no words, nothing removed and the digest of the empty string;
shorter documents keep everything; repeated rows make each other's windows repeat, and all of them lose their words,
so no order decides anything; rows with equal doc_ids are kept apart by their texts; a very long text is one sequence
of words; further columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, Scratch, arrow_batches, as_long, mix, sliding_min, span_hashes, table, text_key, window_hashes, word_spans

WINDOW, SHORTEST = 35, 9


def ladder(window: int, shortest: int = SHORTEST) -> list[int]:
    """Two lengths at least, from about the shortest up to `window`, each at most twice the one before."""
    if window < 2:
        raise ValueError("a window has two words at least")
    out = [window]
    while out[-1] > shortest or len(out) < 2:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' starts, ends and hashes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    starts, ends = word_spans(raw, NOT_SPACE)
    return starts, ends, span_hashes(raw, starts, ends)


def _stand_ins(words: np.ndarray, length: int, window: int) -> np.ndarray:
    """For each start of a whole window, the least hash of the windows of `length` inside it."""
    h = window_hashes(words, length)
    return sliding_min(mix(h), window - length + 1) if len(words) >= window else np.empty(0, dtype=np.uint64)


def _alive(words: np.ndarray, levels: list[int], found: list[list[int]], window: int) -> np.ndarray:
    """Which windows' stand-ins were found to repeat, on all levels so far."""
    alive = np.ones(max(0, len(words) - window + 1), dtype=bool)
    for length, hashes in zip(levels, found, strict=False):
        alive &= np.isin(_stand_ins(words, length, window).view(np.int64), np.array(hashes or [], dtype=np.int64))
    return alive


def _sent(hashes: np.ndarray) -> np.ndarray:
    """Each hash once, or twice if it stands at more than one place."""
    values, n = np.unique(hashes, return_counts=True)
    return np.concatenate([values, values[n > 1]])


def _sent_by_place(stand: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Stand-ins of the windows at `at`: twice those whose shorter window is at more than one place there."""
    values = np.unique(stand[at])
    places, n = np.unique(own[np.isin(own, values)], return_counts=True)
    return np.concatenate([values, places[n > 1]])


def _first(batches, length: int, window: int):
    """All documents: number of words, digest of all words, and the first level's stand-ins."""
    for batch in batches:
        n_words, digest, sent = [], [], []
        for text in batch.column("text"):
            data = text.as_py() or b""
            _, _, words = _words(data)
            n_words.append(len(words))
            digest.append(hashlib.sha256(b" ".join(data.split())).hexdigest())
            stand = _stand_ins(words, length, window)
            sent.append(as_long(_sent_by_place(stand, slice(None), mix(window_hashes(words, length)))) if len(stand) else np.empty(0, dtype=np.int64))
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in sent])]).astype(np.int32), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *sent])))
        yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(n_words, pa.int64()), pa.array(digest), lists], names=["doc_id", "key", "n_words", "all_sha256", "sent"])


def _next(batches, levels: list[int], window: int):
    """Documents with the hashes found on the levels before: what the next level sends."""
    for batch in batches:
        sent = []
        for text, found in zip(batch.column("text"), zip(*(batch.column(f"found{k}").to_pylist() for k in range(len(levels) - 1)), strict=True), strict=True):
            _, _, words = _words(text.as_py() or b"")
            at = np.flatnonzero(_alive(words, levels, list(found), window))
            h = window_hashes(words, levels[-1])
            if not len(at):
                sent.append(np.empty(0, dtype=np.int64))
            elif levels[-1] == window:
                sent.append(as_long(_sent(h[at])))
            else:
                sent.append(as_long(_sent_by_place(_stand_ins(words, levels[-1], window), at, mix(h))))
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in sent])]).astype(np.int32), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *sent])))
        yield pa.record_batch([batch.column("key"), lists], names=["key", "sent"])


def covered(words: np.ndarray, levels: list[int], found: list[list[int]], window: int) -> np.ndarray:
    """Which words lie in a window that repeats."""
    hit = _alive(words, levels[:-1], found, window)
    hit &= np.isin(window_hashes(words, window).view(np.int64), np.array(found[-1] or [], dtype=np.int64))
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _last(batches, levels: list[int], window: int, texts: bool):
    for batch in batches:
        removed, digest, kept = [], [], []
        for text, found in zip(batch.column("text"), zip(*(batch.column(f"found{k}").to_pylist() for k in range(len(levels))), strict=True), strict=True):
            data = text.as_py() or b""
            starts, ends, words = _words(data)
            out = covered(words, levels, list(found), window)
            removed.append(int(out.sum()))
            rest = b" ".join([data[a:b] for a, b in zip(starts[~out].tolist(), ends[~out].tolist(), strict=True)])
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode() if texts else None)
        yield pa.record_batch([batch.column("key"), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.string())], names=["key", "n_removed", "kept_sha256", "kept"])


def repeated(spark: SparkSession, docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, key of the text, n_words, n_removed, kept_sha256 and, with `texts`, what is kept where words go."""
    arrow_batches(spark, 200)
    scratch = Scratch(spark, "substrings")
    levels = ladder(window)
    keyed = docs.select("doc_id", F.col("text").cast("binary").alias("text"), text_key().alias("key"))
    base = scratch.write(keyed.mapInArrow(partial(_first, length=levels[0], window=window), "doc_id long, key binary, n_words long, all_sha256 string, sent array<long>"), "first")
    classes = scratch.write(base.filter("size(sent) > 0").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.first("sent").alias("sent")), "classes")
    live, sent = None, classes.select("key", "copies", "sent")
    for k in range(len(levels)):
        each = sent.select("key", "copies", F.explode("sent").alias("h"))
        often = each.groupBy("h").agg(F.sum("copies").alias("n")).filter("n > 1").select("h")
        found = each.select("key", "h").join(often, "h").groupBy("key").agg(F.collect_set("h").alias(f"found{k}"))
        found = scratch.write(found, f"found{k}")
        if live is None:
            # the representatives' texts: by doc_id too, so that a class of many rows is not gathered
            ids = found.join(classes.select("key", "copies", F.xxhash64("key", "least").alias("pick")), "key")
            live = keyed.select("text", "key", F.xxhash64("key", "doc_id").alias("pick")).join(ids, ["pick", "key"]).dropDuplicates(["pick", "key"]).drop("pick")
        else:
            live = live.join(found, "key")
        live = scratch.write(live, f"live{k}")
        if k:
            scratch.drop(f"live{k - 1}")
        if k + 1 < len(levels):
            sent = scratch.write(live.drop("copies").mapInArrow(partial(_next, levels=levels[: k + 2], window=window), "key binary, sent array<long>"), f"sent{k + 1}").join(live.select("key", "copies"), "key")
    out = live.drop("copies").mapInArrow(partial(_last, levels=levels, window=window, texts=texts), "key binary, n_removed long, kept_sha256 string, kept string")
    out = scratch.write(out, "out")
    rows = base.select("doc_id", "key", "n_words", "all_sha256").join(out, "key", "left")
    return rows.select("doc_id", "key", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"), "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
