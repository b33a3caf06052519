"""What a tool result could reach, and what of it did.

Every node leads to the next, so what a node reaches is a suffix of its trace. It starts after the node; a join
back from a call inside the suffix (or from the node) to an earlier result lowers the start. Taking joins by
descending call, one pass finds it. Values are matched two ways: canonical text inside canonical arguments for
labelled classes, and distinctive tokens of the result inside the arguments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.catalog import SINKS, SourceClass
from tracesift.functions.arguments import leaves
from tracesift.functions.eligibility import canon, distinctive_tokens, eligible


def reachable(nodes: DataFrame, joins: DataFrame) -> DataFrame:
    """Adds `lo`: the node reaches exactly the nodes of its trace from there on.

    A join whose result comes after its call lowers no start, so only joins that run backwards (clocks that differ)
    are gathered for a trace.
    """
    lists = joins.filter("result_idx <= call_idx").groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct(F.col("call_idx").alias("c"), F.col("result_idx").alias("r"))), asc=False).alias("joins"))
    start = F.expr("aggregate(coalesce(joins, array()), idx + 1, (lo, j) -> CASE WHEN j.c >= lo OR j.c = idx THEN least(lo, j.r) ELSE lo END)")
    return nodes.join(lists, "trace_id", "left").withColumn("lo", start).drop("joins")


def context(nodes: DataFrame, joins: DataFrame) -> DataFrame:
    """What each node taints: the first and the last node of its trace that it reaches, none if it is the last one."""
    ends = nodes.groupBy("trace_id").agg(F.max("idx").alias("last_idx"))
    return reachable(nodes, joins).join(ends, "trace_id").filter("lo <= last_idx").select("trace_id", "idx", "lo", "last_idx")


def sink_calls(nodes: DataFrame, sinks: dict[str, tuple[str, ...]] = SINKS) -> DataFrame:
    """Calls to outbound tools with the strings they send."""
    rows = nodes.filter((F.col("kind") == "tool_call") & ~F.col("degraded") & F.col("tool_name").isin(*sinks))
    return rows.select("trace_id", F.col("idx").alias("sink_idx"), leaves(F.col("args")).alias("sent"), F.col("tool_name").alias("sink"))


def origins(nodes: DataFrame, joins: DataFrame) -> DataFrame:
    """The tool whose call gave each result, by the first join."""
    first = joins.groupBy("trace_id", "result_idx").agg(F.min("call_idx").alias("idx"))
    return first.join(nodes.select("trace_id", "idx", "tool_name"), ["trace_id", "idx"]).select("trace_id", "result_idx", F.col("tool_name").alias("origin"))


def provenance(nodes: DataFrame, joins: DataFrame, sinks: dict[str, tuple[str, ...]] = SINKS) -> DataFrame:
    """One flow for each (result, sink): the first token, in sorted order, of the result that the sink's arguments hold."""
    results = reachable(nodes.filter("kind = 'tool_result'"), joins).select("trace_id", F.col("idx").alias("result_idx"), "lo", F.explode(distinctive_tokens(F.col("content"))).alias("token"))
    flows = results.join(sink_calls(nodes, sinks), "trace_id").filter("sink_idx >= lo AND exists(sent, x -> contains(x, token))")
    flows = flows.groupBy("trace_id", "result_idx", "sink_idx", "sink").agg(F.min("token").alias("token"))
    return flows.join(origins(nodes, joins), ["trace_id", "result_idx"], "left")


def untrusted(flows: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """Flows out of tools that bring in what others wrote."""
    return flows.filter(F.col("origin").isin(*tools)) if tools else flows.limit(0)


def labels(nodes: DataFrame, classes: tuple[SourceClass, ...]) -> DataFrame:
    """trace_id, source_idx, class, value of every class in every text of the trace, each once."""
    texts = nodes.filter("kind <> 'tool_call' AND content IS NOT NULL")
    named = lambda name: lambda v: F.struct(F.lit(name).alias("class"), v.alias("value"))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("content", F.lit(c.pattern), 0), named(c.name)) for c in classes]))
    return texts.select("trace_id", F.col("idx").alias("source_idx"), F.explode(F.array_distinct(found)).alias("x")).select("trace_id", "source_idx", "x.*")


def eligible_labels(nodes: DataFrame, classes: tuple[SourceClass, ...]) -> DataFrame:
    """Labels whose value clears its class's floor: classes without one only feed review."""
    found = labels(nodes, classes)
    ok = F.lit(False)
    for c in classes:
        ok = F.when(F.col("class") == c.name, eligible(F.col("value"), c)).otherwise(ok)
    return found.filter(ok)


def matched(sources: DataFrame, nodes: DataFrame, joins: DataFrame, sinks: dict[str, tuple[str, ...]] = SINKS) -> DataFrame:
    """Sources (trace_id, source_idx, ..., value) whose value, in canonical form, a string of a sink they reach holds."""
    starts = reachable(nodes.select("trace_id", "idx"), joins).withColumnRenamed("idx", "source_idx")
    rows = sources.join(starts, ["trace_id", "source_idx"]).join(sink_calls(nodes, sinks), "trace_id")
    rows = rows.withColumn("value_c", canon(F.col("value"))).filter((F.col("sink_idx") >= F.col("lo")) & F.exists("sent", lambda x: F.contains(canon(x), F.col("value_c"))))
    return rows.drop("lo", "sent", "value_c")


def verbatim(nodes: DataFrame, joins: DataFrame, pattern: str) -> DataFrame:
    """Values of results that look like the pattern, found in the arguments of sinks that the result reaches."""
    results = nodes.filter("kind = 'tool_result'")
    values = results.select("trace_id", F.col("idx").alias("source_idx"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), 0))).alias("value"))
    return matched(values, nodes, joins).select("trace_id", "source_idx", "sink_idx", "sink", "value")


def witness(nodes: DataFrame, joins: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shortest path from each source to each sink, the next node before joins: per trace, breadth first.

    With whether a node on it is degraded, and the tiers, sorted, of the joins along it that are weaker than nesting.
    """

    def one(key, want, edges):
        import pandas as pd

        jumps: dict[int, list[int]] = {}
        tier = {}
        for c, r, confidence in sorted(zip(edges["call_idx"], edges["result_idx"], edges["confidence"], strict=True)):
            jumps.setdefault(c, []).append(r)
            tier[c, r] = confidence
        bad = {int(x) for x in want["bad"].iloc[0]} if len(want) else set()
        out = []
        for source, group in want.groupby("source_idx"):
            last, came, line = int(group["last_idx"].max()), {int(source): None}, [int(source)]
            for at in line:
                for to in [*([at + 1] if at < last else []), *jumps.get(at, [])]:
                    if to not in came:
                        came[to] = at
                        line.append(to)
            for sink in group["sink_idx"]:
                path, at = [], int(sink) if int(sink) in came else None
                while at is not None:
                    path.append(at)
                    at = came[at]
                path = path[::-1]
                weak = {tier[step] for step in zip(path, path[1:], strict=False) if step in tier} - {"explicit", "nested"}
                out.append((key[0], int(source), int(sink), len(path) - 1, path, not bad.isdisjoint(path), sorted(weak)))
        return pd.DataFrame(out, columns=["trace_id", "source_idx", "sink_idx", "steps", "path", "degraded", "tiers"])

    ends = nodes.groupBy("trace_id").agg(F.max("idx").alias("last_idx"), F.collect_list(F.when(F.col("degraded"), F.col("idx"))).alias("bad"))
    want = pairs.select("trace_id", "source_idx", "sink_idx").distinct().join(ends, "trace_id")
    edges = joins.select((F.col("trace_id") + 0).alias("trace_id"), "call_idx", "result_idx", "confidence")  # columns of its own
    found = want.groupBy("trace_id").cogroup(edges.groupBy("trace_id")).applyInPandas(one, "trace_id long, source_idx int, sink_idx int, steps int, path array<int>, degraded boolean, tiers array<string>")
    return found.filter("steps >= 0")
