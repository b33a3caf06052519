"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

The automaton holds every run of words of every item. Training words are streamed through it, keeping the
longest run that ends at the present word and occurs in an item; where that reaches the window length (or a
whole shorter item), the words are hit, and the state tells which items hold the run. Spans of hit words are
cut out of the text; a document of which they cover more than a limit is dropped.

The items come to the driver in groups of at most `group_words` words, as many automata as that takes; each
is sent to the executors by itself and documents pass through them one after another, so neither a broadcast nor the
driver, which holds the automaton at work and the next, grows with the benchmark.

Defined cases: a null or wordless text has no words and is clean; a null or wordless item has no window; an
item without an item_id marks words but is not counted; equal items are all counted, repeated rows of one
item once, so no order decides anything; a very long text is one stream of words; further columns are kept; empty tables
give an empty or a clean result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, byte_class, table, word_spans

WINDOW, GROUP_WORDS = 10, 500_000
#: Of a document's words, the share above which the whole document goes.
COVERAGE = 0.5

_WORD = [b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80]
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))
_INSIDE = byte_class(bytes(b for b in range(256) if _FOLD[b] == 0x20))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, letters a-z and anything past ASCII."""
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items that hold each state's runs."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        kept = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, ids in kept:
            last = 0
            for t in ids:
                last = self._extend(last, t)
        self.least = min([window, *(len(ids) for _, ids in kept)])
        self.items: dict[int, set[str | None]] = {}  # by the state of a whole window
        self.short: dict[int, dict[int, set[str | None]]] = {}  # by state, then length: items shorter than a window
        for item, ids in kept:
            state = 0
            for k, t in enumerate(ids):
                state = self.next[state][t]
                if k + 1 >= window:
                    self.items.setdefault(self._of_length(state, window), set()).add(item)
            if len(ids) < window:
                self.short.setdefault(state, {}).setdefault(len(ids), set()).add(item)

    def _extend(self, last: int, t: int) -> int:
        known = self.next[last].get(t)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, t, known)
        state = self._new(self.length[last] + 1)
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
        else:
            q = self.next[p][t]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, t, q)
        return state

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, t: int, q: int) -> int:
        """A state for the shorter runs of q, those that p's longest run and t make."""
        half = self._new(self.length[p] + 1)
        self.next[half] = dict(self.next[q])
        self.link[half], self.link[q] = self.link[q], half
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = half
            p = self.link[p]
        return half

    def _of_length(self, state: int, length: int) -> int:
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """The runs of words hit, as (first, end) in ascending order of end, and the items that occur."""
        follow, link, length, least, window = self.next, self.link, self.length, self.least, self.window
        spans, items, at, n = [], set(), 0, 0
        for end, t in enumerate(map(self.vocabulary.get, words), 1):
            if t is None:
                at = n = 0
                continue
            to = follow[at].get(t)
            while to is None and at:
                at = link[at]
                n = length[at]
                to = follow[at].get(t)
            if to is None:
                n = 0
                continue
            at = to
            n += 1
            if n >= least:
                if n >= window:
                    spans.append((end - window, end))
                    items.update(self.items[self._of_length(at, window)])
                if self.short:
                    s = at
                    while s > 0:
                        for size, found in self.short.get(s, {}).items():
                            if size <= n:
                                spans.append((end - size, end))
                                items.update(found)
                        s = link[s]
        return spans, items


def groups(benchmark: DataFrame, window: int = WINDOW, most: int = GROUP_WORDS) -> Iterable[Automaton]:
    """Automata of at most `most` words each (one item may be longer), over items streamed to the driver."""
    held, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = words_of(row["text"])
        held.append((row["item_id"], words))
        n += len(words)
        if n >= most:
            yield Automaton(held, window)
            held, n = [], 0
    if held:
        yield Automaton(held, window)


_FOUND = "n_words long, spans array<struct<first: int, end: int>>, items array<string>"
_TYPES = [pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans to disjoint ones; those that touch become one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def _scan(batches, automaton, more: bool):
    """Adds what one automaton finds to what others found before; text goes on only if `more`."""
    for batch in batches:
        n_words, all_spans, all_items = [], [], []
        for text, spans, items in zip(batch.column("text"), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            words = words_of(text.as_py())
            found, which = automaton.value.scan(words)
            n_words.append(len(words))
            all_spans.append([{"first": a, "end": b} for a, b in merged(found + [(s["first"], s["end"]) for s in spans])] if found else spans)
            all_items.append(sorted(which.difference([None]).union(items)))
        columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"n_words": pa.array(n_words, _TYPES[0]), "spans": pa.array(all_spans, _TYPES[1]), "items": pa.array(all_items, _TYPES[2])}
        names = [c for c in batch.schema.names if more or c != "text"]
        yield pa.record_batch([columns[c] for c in names], names=names)


def _then(batches, automaton, then):
    yield from then(_scan(batches, automaton, False))


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_words: int = GROUP_WORDS, keep_text: bool = False, then=None, schema=None) -> DataFrame:
    """doc_id (with `keep_text` all columns as one, `row`), n_words, the disjoint spans of words hit, the items found.

    With `then` what it makes of batches of these (`row` for doc_id), in the same Python worker as the last pass.
    """
    arrow_batches(spark)
    scratch = Scratch(spark, "decontamination")
    own = docs if keep_text else docs.select("doc_id", "text")
    now = own.select(F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("row"), F.col("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<first: int, end: int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    if not keep_text:
        now = now.withColumn("row", F.struct("row.doc_id"))
    automata = iter(groups(benchmark, window, group_words))  # built one at a time; the next is needed to know whether texts go on
    automaton, k = next(automata, None) or Automaton([], window), 0
    while automaton is not None:
        following = next(automata, None)
        if following is None and then is not None:
            return now.mapInArrow(partial(_then, automaton=spark.sparkContext.broadcast(automaton), then=then), schema)
        fields = [f for f in now.schema.fields if f.name != "text" or following is not None]
        now = now.mapInArrow(partial(_scan, automaton=spark.sparkContext.broadcast(automaton), more=following is not None), type(now.schema)(fields))
        if following is not None:
            now, k = scratch.write(now, f"pass-{k}"), k + 1
        automaton = following
    return now.select("row" if keep_text else "row.doc_id", "n_words", "spans", "items")


def _digest(batches):
    for batch in batches:
        spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        n_hit = pa.array([sum(s["end"] - s["first"] for s in x) for x in spans], pa.int64())
        sha = pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items])
        yield pa.record_batch([batch.column("row").field("doc_id"), batch.column("n_words"), n_hit, pa.array([len(x) for x in items], pa.int64()), sha], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def without(text: str, spans: list[dict]) -> str:
    """The text without the stretches from each span's first word to its last."""
    data = text.encode()
    starts, ends = word_spans(np.frombuffer(data, dtype=np.uint8), _INSIDE)
    out, at = [], 0
    for s in spans:
        out.append(data[at : starts[s["first"]]])
        at = int(ends[s["end"] - 1])
    return b"".join([*out, data[at:]]).decode()


def _cut(batches, coverage: float):
    for batch in batches:
        row = batch.column("row")
        names = [f.name for f in row.type]
        columns = dict(zip(names, row.flatten(), strict=True))
        keep, texts = [], []
        for text, n, spans in zip(columns["text"], batch.column("n_words").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            keep.append(sum(s["end"] - s["first"] for s in spans) <= coverage * n)
            texts.append(without(text.as_py(), spans) if spans and keep[-1] else text.as_py())
        columns["text"] = pa.array(texts, pa.string())
        yield pa.record_batch([columns[c] for c in names], names=names).filter(pa.array(keep, pa.bool_()))


def remove(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The documents without the spans found; those of which more than `coverage` is hit are dropped."""
    return find(spark, docs, benchmark, window, keep_text=True, then=partial(_cut, coverage=coverage), schema=docs.schema)


def op7_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string"
    rows = find(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), then=_digest, schema=digest)
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


OP7_SQL = """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+'), []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+'), []) AS w FROM benchmark),
iw AS (SELECT item, least(10, len(w)) AS n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM iw),
sizes AS (SELECT DISTINCT n FROM windows),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
found AS (SELECT dp.doc_id, dp.p, dp.n, windows.item FROM dp JOIN windows ON windows.n = dp.n AND windows.s = array_to_string(dp.w[dp.p:dp.p + dp.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)
"""
