"""Traces, surfaces and ledgers read out of the driver's tables.

A user's events are one trace: clicks and signups are tool calls, views and purchases tool results, errors are
tool calls whose arguments were not captured. `props.k` is the explicit call id; a result that directly follows
a call is nested in it. A conversation is a trace of messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracesift.sources.otlp import mined_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, idx, node_id, kind, degraded, tool_name, call_id, parent_id, content (of results), args (of calls), mined_id."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    kind = F.when(F.col("event_type").isin("view", "purchase"), "tool_result").otherwise("tool_call")
    tool = F.when(F.col("event_type") == "click", "send_email").when(F.col("event_type") == "signup", "post_to_webhook").when(F.col("event_type") == "error", "read_file")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.withColumns({"idx": F.row_number().over(order) - 1, "kind": kind, "tool_name": tool, "degraded": F.col("event_type") == "error"})
    before = W.partitionBy("user_id").orderBy("idx")
    nested = (F.col("kind") == "tool_result") & (F.lag("kind").over(before) == "tool_call")
    value = F.concat(F.lit("item"), "k", F.lit("-user"), F.col("user_id").cast("string"))
    nodes = rows.select(
        F.col("user_id").alias("trace_id"), "idx", F.col("event_id").alias("node_id"), "kind", "degraded", "tool_name", F.col("k").alias("call_id"),
        F.when(nested, F.lag("event_id").over(before)).alias("parent_id"),
        F.when(F.col("kind") == "tool_result", F.concat(F.lit("found "), value, F.lit(" in stock"))).alias("content"),
        F.when((F.col("kind") == "tool_call") & ~F.col("degraded"), F.concat(F.lit("please ship "), value, F.lit(" now"))).alias("args"),
    )
    return nodes.withColumn("mined_id", mined_id())


#: The same in SQL, for the oracles: view `nodes`.
NODES_SQL = """
e AS (SELECT event_id, ts, user_id, event_type, json_extract_string(props, '$.k') AS k FROM events),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) - 1 AS idx,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'tool_result' ELSE 'tool_call' END AS kind,
  CASE event_type WHEN 'click' THEN 'send_email' WHEN 'signup' THEN 'post_to_webhook' WHEN 'error' THEN 'read_file' END AS tool_name,
  event_type = 'error' AS degraded FROM e),
nodes AS (SELECT user_id AS trace_id, idx, event_id AS node_id, kind, degraded, tool_name, k AS call_id,
  CASE WHEN kind = 'tool_result' AND lag(kind) OVER w = 'tool_call' THEN lag(event_id) OVER w END AS parent_id,
  CASE WHEN kind = 'tool_result' THEN 'found item' || k || '-user' || user_id || ' in stock' END AS content,
  CASE WHEN kind = 'tool_call' AND NOT degraded THEN 'please ship item' || k || '-user' || user_id || ' now' END AS args
  FROM o WINDOW w AS (PARTITION BY user_id ORDER BY idx))"""


def message_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "assistant", "llm_call").otherwise("user_input")
    order = W.partitionBy("conv_id").orderBy("turn", "role")
    return c.select(F.col("conv_id").alias("trace_id"), (F.row_number().over(order) - 1).alias("idx"), kind.alias("kind"), F.length("text").alias("content_chars"))


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string of the text tables: surface, record id, text. Nulls stay, so that they can be counted as unread."""
    part = lambda name, record, column: table(spark, sf_dir, name).select(F.lit(f"{name}.{column}").alias("surface"), F.col(record).alias("record"), F.col(column).alias("text"))
    parts = [part("documents", "doc_id", "text"), part("pages", "page_id", "html"), part("pages", "page_id", "url"), part("conversations", "conv_id", "text"), part("events", "event_id", "props")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SURFACES_SQL = """
surfaces AS (SELECT 'documents.text' AS surface, doc_id AS record, text FROM documents UNION ALL SELECT 'pages.html', page_id, html FROM pages
  UNION ALL SELECT 'pages.url', page_id, url FROM pages UNION ALL SELECT 'conversations.text', conv_id, text FROM conversations
  UNION ALL SELECT 'events.props', event_id, props FROM events)"""


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of exact values: the distinct service tokens that documents assign, with an id each."""
    found = table(spark, sf_dir, "documents").filter(F.col("text").contains("token")).select(F.explode(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})"'), 1)).alias("value")).distinct()
    return found.select(F.substring(F.sha2("value", 256), 1, 8).alias("placement"), "value")


PLACEMENTS_SQL = """
placements AS (SELECT substr(sha256(value), 1, 8) AS placement, value FROM (SELECT DISTINCT unnest(regexp_extract_all(text, 'token = "([0-9a-f]{40})"', 1)) AS value FROM documents))"""
