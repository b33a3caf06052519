"""Telemetry exports: one JSON document, an array, or JSON lines, to spans, their strings and a ledger.

Nothing is skipped in silence: what cannot be read is a ledger row with a reason, and every row keeps its file
and line. Both spellings of structural keys (camelCase and snake_case) are read; attributes keep their order,
and of a key that repeats the first counts.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from tracesift.walk import any_value, parsed

_SPANS = "file string, line long, trace_id string, span_id string, parent_id string, name string, kind int, start_nanos decimal(20,0), end_nanos decimal(20,0), scope string, schema_url string, attributes array<struct<key: string, value: string, is_string: boolean>>, reason string"
#: Fixed: names of span kinds in wire order.
KINDS = ("SPAN_KIND_UNSPECIFIED", "SPAN_KIND_INTERNAL", "SPAN_KIND_SERVER", "SPAN_KIND_CLIENT", "SPAN_KIND_PRODUCER", "SPAN_KIND_CONSUMER")
#: Fixed: the schema of the dialect that is read, and its attributes.
SCHEMA = "https://opentelemetry.io/schemas/1.42.0"
DIALECT = ("gen_ai.input.messages", "gen_ai.operation.name", "gen_ai.output.messages", "gen_ai.provider.name", "gen_ai.system_instructions", "gen_ai.tool.call.arguments", "gen_ai.tool.call.id", "gen_ai.tool.call.result", "gen_ai.tool.name")
#: Fixed: structural keys in both spellings; attributes and bodies are never renamed.
SIGNALS = {"spans": ("resourceSpans", "scopeSpans", "spans"), "logs": ("resourceLogs", "scopeLogs", "logRecords"), "metrics": ("resourceMetrics", "scopeMetrics", "metrics")}


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def get(record: object, name: str, default: object = None) -> object:
    """A structural member in either spelling."""
    if not isinstance(record, dict):
        return default
    return record.get(name, record.get(_snake(name), default))


def kind_number(kind: object) -> int:
    if isinstance(kind, str):
        return KINDS.index(kind) if kind in KINDS else int(kind) if kind.isdigit() else 0
    return kind if isinstance(kind, int) else 0


def nanos(value: object) -> int | None:
    text = str(value)
    return int(text) if not isinstance(value, bool) and text.isdigit() and int(text) < 1 << 64 else None


def documents(data: bytes) -> list[tuple[int, object, str | None]]:
    """(line, value, reason): the whole as one document or array, else line by line."""
    text = data.removeprefix(b"\xef\xbb\xbf")
    reason = None
    try:
        text.decode()
    except UnicodeDecodeError:
        reason = "invalid_utf8"
    text = text.decode("utf-8", "replace")
    whole, why = parsed(text)
    if why is None:
        return [(1, x, reason) for x in (whole if isinstance(whole, list) else [whole])]
    out = []
    for k, line in enumerate(text.split("\n"), 1):
        if line.strip():
            value, why = parsed(line)
            out.append((k, value, why or reason))
    return out


def records(value: object, signal: str = "spans"):
    """(resource, scope, schema url, record) of every record below one document; a level of another type ends there."""
    top, middle, leaf = SIGNALS[signal]
    for resource in get(value, top) or []:
        for scope in get(resource, middle) or []:
            for record in get(scope, leaf) or []:
                yield get(resource, "resource"), get(scope, "scope"), get(scope, "schemaUrl") or get(resource, "schemaUrl"), record


def _span(file, line, scope, url, r) -> tuple:
    if not isinstance(r, dict):
        return (file, line, *[None] * 10, "undecodable_span")
    attributes = []
    for a in get(r, "attributes") or []:
        if isinstance(a, dict) and isinstance(a.get("key"), str):
            v = any_value(a.get("value"))
            attributes.append({"key": a["key"], "value": v if isinstance(v, str) else None if v is None else json.dumps(v), "is_string": isinstance(v, str)})
    text = lambda x: x if isinstance(x, str) and x else None
    start, end, span = nanos(get(r, "startTimeUnixNano")), nanos(get(r, "endTimeUnixNano")), text(get(r, "spanId"))
    reason = "missing_span_id" if span is None else "garbage_timestamp" if start is None else None
    return (file, line, text(get(r, "traceId")), span, text(get(r, "parentSpanId")), text(get(r, "name")), kind_number(get(r, "kind")), start, end, text(get(scope, "name")), text(url), attributes, reason)


def read_spans(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each span; unreadable lines and spans are rows with a reason and nulls."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def decode(batches):
        from decimal import Decimal

        import pyarrow as pa

        attribute = pa.struct([("key", pa.string()), ("value", pa.string()), ("is_string", pa.bool_())])
        types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.decimal128(20, 0), pa.decimal128(20, 0), pa.string(), pa.string(), pa.list_(attribute), pa.string()]
        names = [c.split()[0] for c in _SPANS.split(", ") if not c.startswith(("value:", "is_string:"))]
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out = []
                for line, value, why in documents(content.as_py()):
                    spans = list(records(value)) if value is not None else []
                    if why or not spans:
                        out.append((file, line, *[None] * 10, why or "no_spans"))
                    out += [_span(file, line, scope, url, r) for _, scope, url, r in spans]
                out = [(*r[:7], *(None if x is None else Decimal(x) for x in r[7:9]), *r[9:]) for r in out]
                yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return found.mapInArrow(decode, _SPANS)


def attribute(name: str):
    """The first attribute of that name, if it is a string."""
    first = F.get(F.filter("attributes", lambda a: a["key"] == name), 0)
    return F.when(first["is_string"], first["value"])


def mined_id():
    """The string under tool_call_id of a call's arguments or a result's content, where that is a JSON object."""
    text = F.when(F.col("kind") == "tool_call", F.col("args")).when((F.col("kind") == "tool_result") & F.col("content").startswith("{"), F.col("content"))
    value = F.try_variant_get(F.try_parse_json(text), "$.tool_call_id", "variant")
    found = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.when(found != "", found)


@arrow_udf(returnType=StringType())
def content_fault(text: pa.Array) -> pa.Array:
    """Why text is no JSON object: truncated_content if it ends too early, else unparseable_content."""
    out = []
    for t in text.to_pylist():
        value, why = parsed(t) if t is not None else (None, None)
        out.append(None if t is None or isinstance(value, dict) else "truncated_content" if why == "truncated" else "unparseable_content")
    return pa.array(out, pa.string())


def known_dialect(spans: DataFrame) -> DataFrame:
    """One row, `known`: a schema or an attribute of a dialect we read stands somewhere in the export."""
    mine = (F.col("schema_url") == SCHEMA) | F.exists("attributes", lambda a: a["key"].isin(*DIALECT))
    return spans.filter("reason IS NULL OR reason <> 'no_spans'").agg(F.coalesce(F.bool_or(F.coalesce(mine, F.lit(False))), F.lit(False)).alias("known"))


def iso(nanos_: Column) -> Column:
    """Nanoseconds since 1970 as ISO 8601 in UTC: microseconds where there are any, finer parts cut off."""
    micros = F.floor(nanos_ / 1000).cast("long")
    at = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)"))
    tail = F.lpad((micros % 1_000_000).cast("string"), 6, "0")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros % 1_000_000 != 0, F.concat(F.lit("."), tail)).otherwise(""), F.lit("Z"))


def looks_like_telemetry(data: bytes) -> bool:
    """Does the file, or its first line that is JSON, hold spans or log records."""
    for _, value, why in documents(data):
        if why is None or value is not None:
            return isinstance(value, dict) and any(get(value, k) is not None for k in ("resourceSpans", "resourceLogs"))
    return False


def ledger(spans: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """What was degraded and why: reason, subject, n. With the nodes made of the spans also what is wrong with those."""
    rows = spans.filter("reason IS NOT NULL").select("reason", F.coalesce("span_id", F.lit("?")).alias("subject"))
    plain = spans.filter("reason IS NULL")
    rows = rows.unionByName(plain.filter(~F.exists("attributes", lambda a: a["key"].startswith("gen_ai."))).select(F.lit("not_genai").alias("reason"), F.col("span_id").alias("subject")))
    about = plain.filter(F.exists("attributes", lambda a: a["key"].startswith("gen_ai.")))
    odd = about.filter(~F.col("span_id").rlike("^([0-9a-f]{16}|[0-9a-f]{32})$"))
    rows = rows.unionByName(odd.select(F.lit("nonstandard_id_encoding").alias("reason"), F.lit("resource").alias("subject")))
    ids = about.select("trace_id", F.col("span_id").alias("parent_id")).distinct()
    orphans = about.filter("parent_id IS NOT NULL").join(ids, ["trace_id", "parent_id"], "left_anti")
    rows = rows.unionByName(orphans.select(F.lit("orphaned_parent").alias("reason"), F.col("span_id").alias("subject")))
    twice = about.groupBy("trace_id", "span_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.unionByName(twice.select(F.lit("duplicate_span_id").alias("reason"), F.col("span_id").alias("subject")))
    rows = rows.unionByName(known_dialect(spans).filter("NOT known").select(F.lit("unknown_dialect").alias("reason"), F.lit("resource").alias("subject")))
    if found is not None:
        rows = rows.unionByName(found.filter("reason IS NOT NULL").select("reason", F.col("node_id").alias("subject")))
    return rows.groupBy("reason", "subject").agg(F.count(F.lit(1)).alias("n"))


def nodes(spans: DataFrame) -> DataFrame:
    """Spans about models and tools to trace nodes: identical copies of a span once, calls and results apart, in time order.

    `twin` marks nodes of a span id that differing spans share: joins that touch them are no evidence. `reason` says
    what is wrong with a node's content or time; every node of an export in no dialect we read is degraded.
    """
    digest = F.sha2(F.to_json(F.struct("trace_id", "span_id", "parent_id", "name", "kind", "start_nanos", "end_nanos", "attributes")), 256)
    used = spans.filter("span_id IS NOT NULL").filter(F.exists("attributes", lambda a: a["key"].startswith("gen_ai."))).withColumn("digest", digest).dropDuplicates(["trace_id", "span_id", "digest"])
    copies = F.count(F.lit(1)).over(W.partitionBy("trace_id", "span_id"))
    used = used.withColumn("twin", copies > 1).withColumn("ref", F.when(F.col("twin"), F.concat_ws("~", "span_id", F.substring("digest", 1, 8))).otherwise(F.col("span_id")))
    operation, tool = attribute("gen_ai.operation.name"), attribute("gen_ai.tool.name")
    args, result, call = attribute("gen_ai.tool.call.arguments"), attribute("gen_ai.tool.call.result"), attribute("gen_ai.tool.call.id")
    used = used.withColumns({"tool_name": tool, "args": args, "result": result, "call_id": F.when(call != "", call), "operation": operation})
    is_tool = (F.col("operation") == "execute_tool") | (F.col("operation").isNull() & F.col("tool_name").isNotNull())
    node = lambda kind, content, args, ref, at: F.struct(F.lit(kind).alias("kind"), content.alias("content"), args.alias("args"), ref.alias("node_id"), at.alias("at"))
    none = F.lit(None).cast("string")
    as_call = node("tool_call", none, F.col("args"), F.col("ref"), F.col("start_nanos"))
    as_result = node("tool_result", F.col("result"), none, F.concat("ref", F.lit("#result")), F.greatest("start_nanos", "end_nanos"))
    plan = F.when(is_tool & F.col("result").isNotNull() & F.col("args").isNull(), F.array(as_result)).when(is_tool & F.col("result").isNotNull(), F.array(as_call, as_result)).when(is_tool, F.array(as_call))
    plan = plan.when(F.col("operation").isin("chat", "text_completion", "generate_content") | (F.col("kind") == 3), F.array(node("llm_call", attribute("gen_ai.output.messages"), none, F.col("ref"), F.col("start_nanos"))))
    rows = used.select("trace_id", "parent_id", "tool_name", "call_id", "twin", F.explode(plan).alias("n")).select("trace_id", "parent_id", "tool_name", "call_id", "twin", "n.*")
    empty = F.when(F.col("kind") == "tool_call", F.col("args")).otherwise(F.col("content")).isNull()
    fault = F.when(empty, "missing_content").when(F.col("kind") == "tool_call", content_fault(F.col("args"))).when(F.col("at").isNull(), "invalid_timestamp")
    order = W.partitionBy("trace_id").orderBy(F.col("at").isNull(), "at", "node_id")
    rows = rows.withColumns({"reason": fault, "mined_id": mined_id(), "idx": F.row_number().over(order) - 1}).join(F.broadcast(known_dialect(spans)))  # one row
    degraded = F.col("reason").isNotNull() | F.col("at").isNull() | ~F.col("known")
    return rows.select("trace_id", "idx", "node_id", "kind", degraded.alias("degraded"), "tool_name", "call_id", "parent_id", "content", "args", "mined_id", iso(F.col("at")).alias("at"), "reason", "twin")
