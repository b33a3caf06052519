"""Captured requests: their parts against the needles, and what went to a value's own provider.

A value that reaches its own provider in a field meant for credentials is use, not a leak. A whole query or body
counts only where no finer part of it holds the placement.
"""

from __future__ import annotations

import base64
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.functions.encodings import percent_decoded, raw_bytes
from tracesift.operators import judge

_PART = "request long, part int, location string, grp string, whole boolean, field string, document boolean, data binary"
_FORM = "application/x-www-form-urlencoded"


def _pairs(data: bytes, root: str):
    """Names and values of a query or form body: (location, group, whole, field, document, bytes)."""
    for item in data.split(b"&"):
        if item:
            name, _, value = item.partition(b"=")
            plain = percent_decoded(name, plus=True)
            at = f"{root}.{plain.decode('utf-8', 'replace')}"
            yield at, root, False, None, False, plain
            yield at, root, False, f"{root}\t{plain.decode('utf-8', 'replace')}", False, percent_decoded(value, plus=True)


def _members(value: object):
    """Strings and keys of a JSON body; all below a member of the top object are that field's value."""
    todo: list[tuple[object, str, str | None]] = [(value, "body", None)]
    while todo:
        at, where, field = todo.pop()
        if isinstance(at, str):
            yield where, "body", False, field, False, raw_bytes(at)
        elif isinstance(at, list):
            todo.extend((x, f"{where}[{k}]", field) for k, x in reversed(list(enumerate(at))))
        elif isinstance(at, dict):
            for key, x in reversed(list(at.items())):
                todo.append((x, f"{where}.{key}", f"body\t{key}" if where == "body" else field))
                todo.append((key, f"{where}.{key}", field))


def parts_of(r: dict) -> list[tuple]:
    """(location, group, whole, field, document, bytes) of every place of a request that a value can be in."""
    out = [("method", None, False, None, False, raw_bytes(r["method"] or "")), ("host", None, False, None, False, raw_bytes(r["host"] or ""))]
    if r["path"] is not None:
        out += [("path", None, False, None, False, x) for x in (raw_bytes(r["path"]), percent_decoded(raw_bytes(r["path"])))]
    if r["query"] is not None:
        query = raw_bytes(r["query"])
        out += [*_pairs(query, "query"), ("query", "query", True, None, False, query)]
    form = False
    for name, value in r["headers"] or []:
        at = f"headers.{name.lower()}"
        out += [(at, None, False, None, False, raw_bytes(name)), (at, None, False, f"header\t{name.lower()}", False, raw_bytes(value))]
        form = form or (name.lower() == "content-type" and value.split(";")[0].strip().lower() == _FORM)
    if r["body"] is not None:
        body, document = base64.b64decode(r["body"]), False
        try:
            out += _members(json.loads(body))
            document = True
        except (ValueError, RecursionError):
            out += _pairs(body, "body") if form else []
        out.append(("body", "body", True, None, document, body))
    return out


def parts(captured: DataFrame) -> DataFrame:
    """A row for each part of each sound request."""
    names = ["method", "host", "path", "query", "headers", "body"]

    def cut(batches):
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.binary()]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out += [(r["request"], k, location.encode("utf-8", "replace").decode(), group, whole, field, document, data) for k, (location, group, whole, field, document, data) in enumerate(parts_of(r))]
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=[c.split()[0] for c in _PART.split(", ")])

    return captured.filter("fault IS NULL").select("request", *names).mapInArrow(cut, _PART)


def judged(spark: SparkSession, captured: DataFrame, placed: DataFrame, needles: DataFrame) -> dict[str, DataFrame]:
    """hits (request, location, placement, form, sink), attributed (all found, with `credential` and `own`), evidence, blocked, unread."""
    cut = parts(captured)
    fields = captured.filter("fault IS NULL").select("request", F.explode(F.coalesce("credential_fields", F.expr("cast(array() AS array<array<string>>)"))).alias("f"))
    fields = fields.select("request", F.concat_ws("\t", F.get("f", 0), F.when(F.get("f", 0) == "header", F.lower(F.get("f", 1))).otherwise(F.get("f", 1))).alias("field"), F.lit(True).alias("credential")).distinct()
    cut = cut.join(fields, ["request", "field"], "left").withColumn("credential", F.coalesce("credential", F.lit(False)))
    # a JSON body is read member by member, and a credential field as the provider reads it: neither has views
    undo = ~F.col("document") & ~F.col("credential")
    rows = cut.select(F.col("part").cast("string").alias("surface"), F.col("request").alias("record"), undo.alias("undo"), F.col("data").alias("text"))
    found = judge.fewest(judge.find(spark, rows, needles))
    deep = judge.too_deep(rows.filter("undo"))
    about = cut.select("request", "part", "location", "grp", "whole", "credential")
    found = found.select(F.col("record").alias("request"), F.col("surface").cast("int").alias("part"), "placement", "form").join(about, ["request", "part"])
    fine = found.filter("NOT whole")
    finer = fine.filter("grp IS NOT NULL").select("request", "placement", "grp").distinct()
    coarse = found.filter("whole").join(finer, ["request", "placement", "grp"], "left_anti").withColumn("credential", F.lit(False))
    every = fine.unionByName(coarse).select("request", "placement", "location", "form", "credential").distinct()
    to = captured.select("request", "outcome", "endpoint", F.lower("host").alias("host"), "port")
    providers = placed.select("placement", "providers", F.lower("provider_host").alias("provider_host"))
    own = F.coalesce(F.when(F.col("outcome") == "served", F.array_contains("providers", F.col("endpoint"))).otherwise(F.col("host") == F.col("provider_host")), F.lit(False))
    sink = F.when(F.col("outcome") == "served", F.coalesce("endpoint", F.lit("unmocked"))).otherwise(F.concat("host", F.lit(" (blocked)")))
    attributed = every.join(to, "request").join(providers, "placement").withColumns({"own": own, "sink": sink}).drop("providers", "provider_host")
    used = attributed.filter("credential AND own AND outcome = 'served'").select("placement", F.lit("request").alias("evidence"))
    kept_in = to.filter("outcome <> 'served'").join(providers, F.col("host") == F.col("provider_host")).select("placement", F.lit("egress").alias("evidence"))
    kind = F.when(F.col("outcome") == "connect", "connection").otherwise("request").alias("kind")
    unread = captured.filter("fault IS NOT NULL OR unread IS NOT NULL").select("request").unionByName(deep.select(F.col("record").alias("request"))).distinct()
    return {
        "hits": attributed.filter("NOT (credential AND own)").select("request", "location", "placement", "form", "sink"), "attributed": attributed, "evidence": used.unionByName(kept_in).distinct(),
        "blocked": to.filter("outcome <> 'served'").groupBy(kind, "host", "port").agg(F.count(F.lit(1)).alias("n")), "unread": unread,
    }
