"""Exact values over a capture: every spelling of every placement against every string and its views, then a verdict.

Needles are a table of their own, never literals. One pass in Arrow batches finds all of them by an automaton over a
piece of each; a ledger of more than GROUP needles takes several. A text that holds JSON is also searched as it reads once its escapes are undone,
as often as that changes it; a value counts there only where the text itself does not hold it, at the fewest undoings.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracesift.functions.arguments import escaped
from tracesift.functions.encodings import FORMS, needles, undoings, views

#: Needles that are broadcast at once; more are handled in groups. Bytes of a needle that the automaton knows.
GROUP, PIECE = 250_000, 16
WITHHELD, RUN = "[withheld]", 6


def needle_table(placements: DataFrame) -> DataFrame:
    """placement, form, rank, needle: a spelling is kept under the first form that gives it."""

    def spell(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(p, form, FORMS.index(form), n) for p, v in zip(batch.column("placement").to_pylist(), batch.column("value").to_pylist(), strict=True) for n, form in needles(v)]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.binary()))], names=["placement", "form", "rank", "needle"])

    return placements.select("placement", "value").mapInArrow(spell, "placement string, form string, rank int, needle binary")


_HIT = "surface string, record long, level int, placement string, form string, rank int"


def find(spark: SparkSession, surfaces: DataFrame, table: DataFrame, forms: tuple[str, ...] = FORMS) -> DataFrame:
    """surface, record, placement, form, rank of every needle that a string holds.

    Where the strings have a column `undo`, those with true are also searched as they read with escapes undone; then
    there is a level (how often), and a placement that a text holds is not looked for at more undoings of it.
    """
    leveled = "undo" in surfaces.columns
    rows = surfaces.filter(F.col("text").isNotNull()).select("surface", "record", (F.col("undo") if leveled else F.lit(False)).alias("undo"), F.col("text").cast("binary").alias("text"))
    out, group = None, []
    for row in table.filter(F.col("form").isin(*forms)).orderBy("placement", "rank", "needle").toLocalIterator():
        group.append((row["placement"], row["form"], row["rank"], bytes(row["needle"])))
        if len(group) == GROUP:
            out, group = _merge(out, _pass(spark, rows, group)), []
    found = _merge(out, _pass(spark, rows, group)) if group or out is None else out
    return found if leveled else found.drop("level")


def _merge(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


class Needles:
    """Which of the needles a text holds. The automaton knows a piece of each, the least shared of three; the rest is compared."""

    def __init__(self, group: list[tuple]):
        import ahocorasick

        # latin-1 maps bytes to letters one to one, so needles need not be text
        of: dict[str, list[tuple]] = {}
        for placement, form, rank, needle in group:
            of.setdefault(needle.decode("latin-1"), []).append((placement, form, rank))
        starts = lambda n: {0, max(len(n) - PIECE, 0) // 2, max(len(n) - PIECE, 0)}
        shared = Counter(n[k : k + PIECE] for n in of for k in starts(n))
        pieces: dict[str, list[tuple]] = {}
        for n, who in of.items():
            at = min(starts(n), key=lambda k: (shared[n[k : k + PIECE]], k))
            pieces.setdefault(n[at : at + PIECE], []).append((at, n, who))
        self.automaton = ahocorasick.Automaton() if pieces else None
        for piece, whole in pieces.items():
            self.automaton.add_word(piece, (len(piece), whole))
        if pieces:
            self.automaton.make_automaton()
        self.longest = max(map(len, of), default=0)
        self.lasts, self.pairs = {n[-1:].encode("latin-1") for n in of}, {n[k : k + 2].encode("latin-1") for n in of for k in range(len(n) - 1)}

    def __call__(self, data: bytes) -> set[tuple]:
        found: set[tuple] = set()
        if self.automaton is not None:
            text = data.decode("latin-1")
            for last, (size, whole) in self.automaton.iter(text):
                for at, needle, who in whole:
                    start = last + 1 - size - at
                    if start >= 0 and text.startswith(needle, start):
                        found.update(who)
        return found

    def anew(self, data: bytes, places: list[tuple[int, int]]) -> set[tuple]:
        """What a text holds that it did not hold before these places of it were undone.

        A needle that lies beside them was there before. One that meets a place ends in it, or goes on after it.
        """
        spans: list[list[int]] = []
        for start, end in places:
            if data[end - 1 : end + 1] in self.pairs or any(data[k : k + 1] in self.lasts for k in range(start, end)):
                first, last = max(start - self.longest, 0), end + self.longest
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = last
                else:
                    spans.append([first, last])
        return {hit for first, last in spans for hit in self(data[first:last])}


#: What a worker has built last, so that each of its tasks need not build it again.
_BUILT: dict[str, Needles] = {}


def _built(name: str, group) -> Needles:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Needles(group())
    return _BUILT[name]


def _pass(spark: SparkSession, rows: DataFrame, group: list[tuple]) -> DataFrame:
    """One automaton over at most GROUP needles, broadcast by itself."""
    sent, name = spark.sparkContext.broadcast(group), uuid.uuid4().hex

    def scan(batches):
        import pyarrow as pa

        held = _built(name, lambda: sent.value)
        for batch in batches:
            out = []
            for surface, record, undo, text in zip(*(batch.column(c).to_pylist() for c in ("surface", "record", "undo", "text")), strict=True):
                found = held(text)
                out += [(surface, record, 0, *hit) for hit in sorted(found)]
                known = {placement for placement, *_ in found}
                for part in json_inside(text) if undo else ():
                    seen = set(known)
                    for level, (view, places) in enumerate(undoings(part)[0], 1):
                        more = [hit for hit in sorted(held.anew(view, places)) if hit[0] not in seen]
                        out += [(surface, record, level, *hit) for hit in more]
                        seen.update(placement for placement, *_ in more)
            types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32())
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[c.split()[0] for c in _HIT.split(", ")])

    return rows.mapInArrow(scan, _HIT)


_OPENS = re.compile(r"[\[{]")


def json_inside(data: bytes) -> list[bytes]:
    """The JSON in a text that has escapes: the whole if it is an object, array or string, else each object or array in it."""
    if b"\\" not in data:
        return []
    text = data.decode("utf-8", "surrogateescape")
    decoder, out, at = json.JSONDecoder(), [], 0
    try:
        if isinstance(json.loads(text), str | list | dict):
            return [data]
    except RecursionError:
        return [data]  # too deep to be told: read as if it were
    except ValueError:
        pass
    while start := _OPENS.search(text, at):
        try:
            _, end = decoder.raw_decode(text, start.start())
        except RecursionError:
            return [data]
        except ValueError:
            at = start.start() + 1
            continue
        out.append(text[start.start() : end].encode("utf-8", "surrogateescape"))
        at = end
    return out


def too_deep(strings: DataFrame) -> DataFrame:
    """surface, record of strings that hold JSON whose escapes undoing did not come to the end of."""

    def undo(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for surface, record, text in zip(*(batch.column(c).to_pylist() for c in ("surface", "record", "text")), strict=True):
                if not all(views(part)[1] for part in json_inside(text)):
                    out.append((surface, record))
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64()))], names=["surface", "record"])

    rows = strings.filter(F.col("text").isNotNull()).select("surface", "record", F.col("text").cast("binary").alias("text"))
    return rows.filter(F.contains("text", F.lit(b"\\"))).mapInArrow(undo, "surface string, record long").distinct()


def decoded(form, level):
    """A needle's form by all the escaping that was undone and that it spells."""
    k = F.array_position(F.array(*map(F.lit, FORMS)), form) - 1
    return F.when((level == 0) | (k > 2), form).when(k + level == 1, F.lit("json")).otherwise(F.lit("json2"))


def find_viewed(spark: SparkSession, strings: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (surface, record, placement, form) in strings and their views, one for each placement and string; and the strings escaped too deep."""
    return fewest(find(spark, strings.select("surface", "record", "text", F.lit(True).alias("undo")), table)), too_deep(strings)


def fewest(found: DataFrame) -> DataFrame:
    """For each placement and string the hits at the fewest undoings, then the first form."""
    place = W.partitionBy("surface", "record", "placement")
    rows = found.withColumn("least", F.min("level").over(place)).filter("level = least")
    best = rows.groupBy("surface", "record", "placement", "level").agg(F.min_by("form", "rank").alias("form"))
    return best.select("surface", "record", "placement", decoded(F.col("form"), F.col("level")).alias("form"))


def first_forms(hits: DataFrame) -> DataFrame:
    """One hit for each placement and place: the form first in the table's order."""
    return hits.groupBy("surface", "record", "placement").agg(F.min_by("form", "rank").alias("form"))


def states(placements: DataFrame, hits: DataFrame, exercised: DataFrame) -> DataFrame:
    """Each placement is leaked, clean if it was exercised, or unknown."""
    n = hits.groupBy("placement").agg(F.count(F.lit(1)).alias("n_hits"), F.array_join(F.array_sort(F.collect_set("form")), ",").alias("forms"))
    rows = placements.select("placement").join(n, "placement", "left").join(exercised.select("placement", F.lit(True).alias("exercised")).distinct(), "placement", "left")
    state = F.when(F.col("n_hits") > 0, "leaked").when(F.col("exercised"), "clean").otherwise("unknown")
    return rows.select("placement", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), F.coalesce("forms", F.lit("")).alias("forms"), state.alias("state"))


def verdict(states_: DataFrame, unread: DataFrame) -> DataFrame:
    """Any hit is a leak; else anything unread or unknown makes it incomplete; only then is it clean."""
    s = states_.agg(F.count_if(F.col("state") == "leaked").alias("leaked"), F.count_if(F.col("state") == "unknown").alias("unknown"), F.count(F.lit(1)).alias("placements"))
    u = unread.agg(F.count(F.lit(1)).alias("unread"))
    v = F.when(F.col("leaked") > 0, "leak").when((F.col("unread") > 0) | (F.col("unknown") > 0), "incomplete").otherwise("clean")
    return s.join(F.broadcast(u)).withColumn("verdict", v)  # one row each


def placement_states(placed: DataFrame, hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each placement with its state: leaked if anything holds it, exercised if something used it, else not_exercised."""
    n = hits.groupBy("placement").agg(F.count(F.lit(1)).alias("n_hits"))
    used = evidence.groupBy("placement").agg(F.array_sort(F.collect_set("evidence")).alias("evidence"))
    rows = placed.select("placement", "kind", "required").join(n, "placement", "left").join(used, "placement", "left")
    state = F.when(F.col("n_hits") > 0, "leaked").when(F.size("evidence") > 0, "exercised").otherwise("not_exercised")
    return rows.select("placement", "kind", "required", state.alias("state"), F.coalesce("evidence", F.expr("cast(array() AS array<string>)")).alias("evidence"), F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"))


def empty_capture(strings: DataFrame) -> DataFrame:
    """A reason, if nothing was there to be searched."""
    n = strings.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return n.select(F.lit("empty_capture").alias("reason"), F.lit("").alias("subject"))


def ledger_reasons(ledger: DataFrame, states_: DataFrame) -> list[DataFrame]:
    """What a ledger says that keeps an answer from being clean."""
    g = lambda name, kind="string": F.try_variant_get("record", f"$.{name}", kind)
    of = lambda kind: ledger.filter(F.col("type") == kind)
    reason = lambda rows, name, subject: rows.select(F.lit(name).alias("reason"), subject.alias("subject"))
    isolated = F.coalesce(g("isolated", "boolean"), F.lit(False))
    return [
        reason(states_.filter("required AND state = 'not_exercised'"), "required_not_exercised", F.col("placement")),
        reason(of("flow").filter(~g("status").eqNullSafe("ok")), "flow_not_ok", F.concat_ws("=", g("id"), g("status"))),
        reason(of("unexpected"), "unexpected_credential", g("id")),
        reason(of("network").filter(F.coalesce(g("required", "boolean"), F.lit(False)) & ~isolated), "network_not_isolated", F.lit("")),
        reason(of("direct"), "direct_connection", F.concat(g("flow"), F.lit("="), g("protocol"), F.lit(":"), g("target"))),
    ]


def decided(states_: DataFrame, reasons: DataFrame) -> DataFrame:
    """One row: any hit is a leak, else any reason makes it incomplete, only then is it clean; with the exit code."""
    s = states_.agg(F.count(F.lit(1)).alias("placements"), *[F.count_if(F.col("state") == x).alias(x) for x in ("leaked", "exercised", "not_exercised")])
    r = reasons.agg(F.count(F.lit(1)).alias("unread"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    v = F.when(F.col("leaked") > 0, "leak").when(F.col("unread") > 0, "incomplete").otherwise("clean")
    return s.join(F.broadcast(r)).withColumn("verdict", v).withColumn("exit_code", F.when(v == "leak", 1).when(v == "incomplete", 3).otherwise(0))


def coverage(states_: DataFrame, strings: DataFrame, listed: DataFrame, reasons: DataFrame) -> DataFrame:
    """One row of counters: what was there, what was read, what was not."""
    parts = [
        states_.agg(F.count(F.lit(1)).alias("placements"), F.count_if("required").alias("required"), *[F.count_if(F.col("state") == x).alias(x) for x in ("leaked", "exercised", "not_exercised")]),
        strings.agg(F.count(F.lit(1)).alias("strings"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes")),
        listed.agg(F.count_if("scannable").alias("files")),
        reasons.agg(F.count_if(F.col("reason") == "not_scanned").alias("files_not_scanned"), F.count_if(F.col("reason") == "unparsed_record").alias("unparsed_records")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.join(F.broadcast(more))  # one row each
    return out


class Display:
    """Text as it may be printed: withheld if it, or a view of it, holds a spelling or any run of RUN characters of a value."""

    def __init__(self, values: list[str]):
        self.spellings = [n for v in values for n, _ in needles(v)]
        self.runs = {v[k : k + RUN] for v in values for k in range(len(v) - RUN + 1)}

    def holds(self, text: str) -> bool:
        texts, complete = views(text.encode("utf-8", "surrogatepass"))
        for data in (text.encode("utf-8", "surrogatepass"), *texts):
            shown = data.decode("utf-8", "surrogatepass")
            if any(n in data for n in self.spellings) or any(shown[k : k + RUN] in self.runs for k in range(len(shown) - RUN + 1)):
                return True
        return not complete

    def __call__(self, text: str) -> str:
        flat = escaped(text)
        return WITHHELD if self.holds(text) or self.holds(flat) else flat

    def shown(self, printed: str, *received: str) -> str:
        """Withheld as well if a form in which it came holds a value."""
        return WITHHELD if any(self(x) == WITHHELD for x in (printed, *received)) else self(printed)


def fragments(text: str, values: dict[str, str]) -> list[str]:
    """Names of values of which the text, without their whole spellings, still holds a run of RUN characters."""
    data = text.encode("utf-8", "surrogatepass")
    for v in values.values():
        for n, _ in sorted(needles(v), key=lambda x: -len(x[0])):
            data = data.replace(n, b"\0")
    left = data.decode("utf-8", "surrogatepass")
    return sorted(name for name, v in values.items() if any(v[k : k + RUN] in left for k in range(len(v) - RUN + 1)))
