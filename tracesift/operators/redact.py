"""Stored values out of texts and JSON results: each occurrence becomes a note that names it.

Needles come as a broadcast table of bounded size; overlapping finds become one replacement that names each
value. JSON keeps its shape: only strings change.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tracesift.functions.encodings import needles

#: Values that one pass carries to the executors; more take several passes.
MOST = 20_000


def redacted(text: str, finds: list[tuple[int, int, str]]) -> str:
    """The text with overlapping finds (start, end, name) as one note each."""
    out, at, k = [], 0, 0
    finds = sorted(finds)
    while k < len(finds):
        start, end, names = finds[k][0], finds[k][1], [finds[k][2]]
        k += 1
        while k < len(finds) and finds[k][0] < end:
            end = max(end, finds[k][1])
            names.append(finds[k][2])
            k += 1
        out += [text[at:start], f"[{', '.join(dict.fromkeys(names))} removed]"]
        at = end
    return "".join([*out, text[at:]])


def redact(spark: SparkSession, texts: DataFrame, placements: DataFrame) -> DataFrame:
    """(id, text) with every spelling of every value replaced; JSON documents are walked, other texts read whole."""
    out, group = texts.select("id", "text"), {}
    # groups of MOST values, one after another: what one group has put in place of a value is no value of the next
    for r in placements.select("placement", "value").orderBy("placement", "value").toLocalIterator():
        for n, _ in needles(r["value"]):
            group.setdefault(n.decode("utf-8", "surrogateescape"), []).append(r["placement"])
        if len(group) >= 40 * MOST:
            out, group = _pass(spark, out, group), {}
    return _pass(spark, out, group) if group else out


def _pass(spark: SparkSession, texts: DataFrame, group: dict[str, list[str]]) -> DataFrame:
    """One automaton over a group's spellings; values that share a spelling are all named."""
    sent = spark.sparkContext.broadcast(group)

    def one(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for spelling, names in sent.value.items():
            automaton.add_word(spelling, (names, len(spelling)))
        automaton.make_automaton()

        def clean(value):
            if isinstance(value, str):
                found = [(end + 1 - size, end + 1, name) for end, (names, size) in automaton.iter(value) for name in names]
                return redacted(value, found) if found else value
            if isinstance(value, list):
                return [clean(x) for x in value]
            return {k: clean(x) for k, x in value.items()} if isinstance(value, dict) else value

        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                try:
                    whole = json.loads(text) if text and text[0] in "{[" else None
                except (ValueError, RecursionError):
                    whole = None
                out.append(clean(text) if whole is None else json.dumps(clean(whole), ensure_ascii=False))
            yield pa.record_batch([batch.column("id"), pa.array(out, pa.string())], names=["id", "text"])

    return texts.select("id", "text").mapInArrow(one, texts.select("id", "text").schema)
