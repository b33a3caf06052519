"""What of a session reached the agent: the first place of each value, what to do, and one line that says how it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns of hits that no prompt precedes, or whose turn is not known, come last.
_LAST = 1 << 30


def how() -> Column:
    """What a hit sat in, in words, from kind, tool, argument, record_type, path and format."""
    tool = F.coalesce("tool", F.lit("a"))
    call = F.concat(tool, F.lit(" tool call"), F.when(F.col("argument").isNotNull(), F.concat(F.lit(", argument "), F.col("argument"))).otherwise(""))
    user = F.when(F.col("tool").isNotNull(), F.concat("tool", F.lit(" tool result"))).when(F.col("path") == "message.content", "prompt").otherwise("user message")
    return (
        F.when(F.col("format") == "memory", "memory file").when(F.col("format") == "tool_results", "saved tool output").when(F.col("kind") == "tool_call", call)
        .when(F.col("record_type") == "user", user).when(F.col("record_type") == "assistant", "model's own text").when(F.col("record_type").isin("attachment", "summary"), F.col("record_type"))
        .otherwise(F.concat(F.coalesce("record_type", "format"), F.lit(" record")))
    )


def firsts(hits: DataFrame) -> DataFrame:
    """For each credential and kind the first hit: by turn, known turns first, the session itself before subagents, then file and line."""
    order = F.struct(F.coalesce("turn", F.lit(_LAST)).alias("t"), "subagent", "file", "line", "path")
    rows = hits.withColumn("how", how())
    best = rows.groupBy("credential", "kind").agg(F.min(F.struct(order.alias("o"), "how", "is_error")).alias("b"), F.count(F.lit(1)).alias("hits"), F.bool_or(F.col("is_error")).alias("through_failed_call"))
    return best.select("credential", "kind", F.when(F.col("b.o.t") < _LAST, F.col("b.o.t")).alias("turn"), F.col("b.o.subagent").alias("subagent"), F.col("b.o.file").alias("file"), F.col("b.o.line").alias("line"), F.col("b.how").alias("how"), "hits", "through_failed_call")


def advice(states: DataFrame, credentials: DataFrame, hits: DataFrame) -> DataFrame:
    """For each credential (source, display, name, in_startup) with a place what to do about it, as a list of steps."""
    held = hits.filter("kind IN ('tool_call', 'context', 'stored')").groupBy("credential").agg(F.array_sort(F.collect_set("file")).alias("files"), F.array_sort(F.collect_set(F.when(F.col("format") == "tool_results", F.col("file")))).alias("saved"))
    rows = states.filter("state <> 'not_found'").join(credentials, "credential").join(held, "credential", "left")
    reached = F.col("state").isin("in_tool_call", "in_context")
    source = F.when(F.col("in_startup"), F.concat(F.lit("take it out of "), F.col("display"), F.lit(", which exports it into the environment")))
    source = source.when(F.col("source") == "environment", F.concat(F.lit("remove "), F.col("name"), F.lit(" from the environment the agent starts with")))
    source = source.otherwise(F.concat(F.lit("take it out of "), F.col("display"), F.lit(", or deny the agent read access to that file")))
    steps = F.when(reached, F.array_compact(F.array(F.lit("rotate it at its issuer"), source, F.when(F.size("files") > 0, "delete the session files above once it is rotated"))))
    steps = steps.when(F.col("state") == "unknown", F.array(F.lit("open the place named above: it cannot be told whether the agent read it")))
    steps = steps.when(F.size("saved") > 0, F.array(F.concat(F.lit("it has not entered the context, but a saved tool output holds it: delete "), F.array_join("saved", ", "))))
    return rows.select("credential", "state", steps.otherwise(F.array(F.lit("nothing reached the agent; it is kept in the bookkeeping named above"))).alias("steps"))


def status(states: DataFrame, unread: DataFrame) -> DataFrame:
    """One row: how many values reached the agent, what was not read, and the line that says so; only a full reading without a find is good."""
    s = states.agg(F.count_if(F.col("state").isin("in_tool_call", "in_context")).alias("exposed"), F.count_if(F.col("state") == "unknown").alias("unknown"), F.count(F.lit(1)).alias("checked"))
    rows = s.join(F.broadcast(unread.agg(F.count(F.lit(1)).alias("unread"))))  # one row each
    color = F.when(F.col("exposed") > 0, "red").when((F.col("unread") > 0) | (F.col("unknown") > 0), "yellow").otherwise("green")
    line = F.when(F.col("exposed") > 0, F.concat(F.col("exposed").cast("string"), F.lit(" exposed"))).when((F.col("unread") > 0) | (F.col("unknown") > 0), "partly checked").otherwise(F.concat(F.col("checked").cast("string"), F.lit(" checked, none seen")))
    return rows.withColumn("color", color).withColumn("line", line)


def lines(firsts_: DataFrame, steps: DataFrame) -> list[str]:
    """The report as text, a block for each credential; sorted, so that equal sessions read the same."""
    told = {r["credential"]: r for r in steps.collect()}  # credentials found in one session
    out: list[str] = []
    seen = None
    for r in firsts_.orderBy("credential", "turn", "kind").collect():
        if r["credential"] != seen:
            if seen is not None:
                out.append("  what to do: " + "; ".join(told[seen]["steps"]) if seen in told else "")
            seen = r["credential"]
            out.append(f"{seen}: {told[seen]['state'] if seen in told else 'found'}")
        when = f"turn {r['turn']}" if r["turn"] is not None else "an unknown turn"
        out.append(f"  {when}{', in a subagent' if r['subagent'] else ''}: the {r['how']}, {r['file']}:{r['line']} ({r['hits']}x{', in a failed call' if r['through_failed_call'] else ''})")
    if seen in told:
        out.append("  what to do: " + "; ".join(told[seen]["steps"]))
    return [x for x in out if x]
