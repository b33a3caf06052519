"""Credentials in plain sight: every class over every string, contested places settled, each hit graded."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracesift.catalog import SourceClass
from tracesift.functions.eligibility import class_prefix, eligible, fingerprint, matched_value, rejected


#: Fixed: boundaries a pattern may begin with, and what ends its literal beginning.
_BOUNDARIES, _META = (r"(?:\b|(?<=\\[ntr]))", r"\b"), frozenset("\\.^$*+?{}[]()|")


def literal_prefix(pattern: str) -> str:
    """The letters a pattern begins with, after a boundary: the longer, the more specific the class."""
    for boundary in _BOUNDARIES:
        if pattern.startswith(boundary):
            pattern = pattern[len(boundary) :]
            break
    return "".join(itertools.takewhile(lambda c: c not in _META, pattern))


def needed(text, c: SourceClass):
    """Does a text hold the letters without which a class's pattern cannot match: a plain search, before any regex is tried. True where none are known."""
    where = F.lower(text) if c.pattern.startswith("(?i)") else text
    return functools.reduce(lambda a, b: a | b, [F.contains(where, F.lit(x)) for x in c.needs]) if c.needs else F.lit(True)


def gate(text, classes: tuple[SourceClass, ...]):
    """True for every text with a match of any class: the regexes of all classes that need the same letters are tried together, and only where the text holds them."""
    groups: dict[tuple, list[SourceClass]] = {}
    for c in classes:
        groups.setdefault((c.needs, c.pattern.startswith("(?i)")), []).append(c)
    tests = [needed(text, same[0]) & text.rlike("|".join(f"(?:{c.pattern})" for c in same)) for same in groups.values()]
    return functools.reduce(lambda a, b: a | b, tests)


def candidates(surfaces: DataFrame, classes: tuple[SourceClass, ...]) -> DataFrame:
    """surface, record, class, rank, start (code points, from 0), value, before (the matched text up to the value): every match of every class.

    The rank orders classes by the length of their literal prefix, longest first, then as the catalog does. The table is
    read once; each class's matches are an array, and all of them are exploded together. Offsets come from the pieces
    between matches; a grouped class's value starts where its group does.
    """
    ordered = sorted(classes, key=lambda c: -len(literal_prefix(c.pattern)))
    each = []
    for rank, c in enumerate(ordered):
        whole, pieces = F.regexp_extract_all("text", F.lit(c.pattern), 0), F.split("text", c.pattern, -1)
        z = F.arrays_zip(pieces.alias("p"), whole.alias("m"), F.regexp_extract_all("text", F.lit(c.pattern), c.group).alias("v"))
        none = F.expr("cast(array() AS array<struct<start: int, whole: string, value: string>>)")
        at = F.aggregate(
            F.when(needed(F.col("text"), c) & F.col("text").rlike(c.pattern), z), F.struct(F.lit(0).alias("at"), none.alias("list")),
            lambda a, x: F.struct((a["at"] + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"), F.when(x["m"].isNull(), a["list"]).otherwise(F.concat(a["list"], F.array(F.struct((a["at"] + F.length(x["p"])).alias("start"), x["m"].alias("whole"), x["v"].alias("value"))))).alias("list")),
            lambda a: a["list"])
        each.append(F.transform(F.coalesce(at, none), _ranked(rank)))
    some = surfaces.filter(gate(F.col("text"), classes))
    rows = some.select("surface", "record", F.explode(F.concat(*each)).alias("h")).select("surface", "record", "h.*")
    is_ = lambda c: F.col("rank") == ordered.index(c)
    pick = lambda of, default: _choose([(is_(c), of(c)) for c in classes], default)
    grouped = pick(lambda c: F.lit(bool(c.group)), F.lit(False))
    lead = F.when(grouped, F.length("whole") - F.length("value")).otherwise(0)
    rows = rows.withColumns({"before": F.substring("whole", F.lit(1), lead), "start": F.col("start") + lead, "value": pick(lambda c: matched_value(F.col("value"), c), F.col("value"))})
    return rows.select(
        "surface", "record", pick(lambda c: F.lit(c.name), F.lit(None)).alias("class"), "rank", "start", "value",
        pick(lambda c: eligible(F.col("value"), c), F.lit(False)).alias("eligible"), pick(lambda c: F.lit(c.floor is None and c.structure is None) & rejected(F.col("value"), c), F.lit(False)).alias("dropped"), "before",
    )


def _ranked(rank: int):
    return lambda h: F.struct(F.lit(rank).alias("rank"), h["start"].alias("start"), h["whole"].alias("whole"), h["value"].alias("value"))


def _choose(cases: list[tuple], default):
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return default if out is None else out.otherwise(default)


def settled(found: DataFrame) -> DataFrame:
    """At one place the class with the longest literal prefix wins, then the first in the catalog; what a class without a floor rejects is dropped."""
    place = W.partitionBy("surface", "record", "start").orderBy("rank")
    return found.withColumn("n", F.row_number().over(place)).filter("n = 1 AND NOT dropped").drop("n", "dropped", "rank", "before")


def subsumed(hits: DataFrame) -> DataFrame:
    """Drops review hits whose value holds an eligible hit of another class in the same string: an interval anti join."""
    inner = hits.filter("eligible").select(*[F.col(c).alias(f"i_{c}") for c in ("surface", "record", "class", "start")], F.length("value").alias("i_len"))
    hold = [F.col("surface") == F.col("i_surface"), F.col("record") == F.col("i_record"), F.col("class") != F.col("i_class"), ~F.col("eligible"), F.col("start") <= F.col("i_start"), F.col("i_start") + F.col("i_len") <= F.col("start") + F.length("value")]
    return hits.join(inner, hold, "left_anti")


def graded(hits: DataFrame) -> DataFrame:
    """Value-free findings: class, place, length, head, and fingerprint and last four only of eligible values."""
    length = F.length("value")
    return hits.select(
        "surface", "record", "class", "start", length.alias("value_len"), F.when(F.col("eligible"), class_prefix(F.col("value"))).alias("prefix"),
        F.when(F.col("eligible"), fingerprint(F.col("value"))).alias("fingerprint"), F.when(F.col("eligible") & (length >= 12), F.substring("value", -4, 4)).alias("last4"),
        F.col("eligible").alias("is_verdict_grade"),
    )


def by_fingerprint(findings: DataFrame) -> DataFrame:
    """How far each value spread; ordinals go by first appearance."""
    groups = findings.filter("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("surface", "record").alias("records"), F.countDistinct("surface").alias("surfaces"), F.min(F.struct("surface", "record", "start")).alias("first"))
    # ordinals without one task over all values: each range of first places is ranked by itself and moved by the ranges before
    spread = groups.repartitionByRange("first").withColumn("part", F.spark_partition_id()).persist()
    sizes = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("skip", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row for each partition
    own = F.row_number().over(W.partitionBy("part").orderBy("first"))
    return spread.withColumn("own", own).join(before, "part").select("fingerprint", "hits", "records", "surfaces", (F.col("own") + F.col("skip")).alias("ordinal"))
