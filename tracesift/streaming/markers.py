"""Redaction as it happens: which results were cleaned before the agent saw them, which were not, and what is still read.

A marker says that cleaning a call's result began, and later that it was done or failed; one that stays pending past a
time has failed. A result whose call is covered and that has no done marker was not cleaned. State is kept by call and
goes once the result has been judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds after which a pending marker has failed, days after which a session's markers are counted together, seconds for which an open last line is being written, bytes of a line that is searched only a few times.
TIMEOUT_S, FOLD_DAYS, FRESH_S, LONG, TRIES = 10, 7, 5, 128 << 10, 3
_OUT = "session string, call string, outcome string"
_STATE = "waiting boolean, marker string, at double"


def settled(markers: DataFrame, now: float) -> DataFrame:
    """session, call, outcome (done, failed or pending) of markers (session, call, state, at, kept_out): the last one by time counts."""
    last = markers.groupBy("session", "call").agg(F.max_by(F.struct("state", "at", "kept_out"), F.struct("at", "state")).alias("m"))
    late = F.lit(now) - F.col("m.at") > TIMEOUT_S
    outcome = F.when(F.col("m.state") == "done", "done").when((F.col("m.state") == "pending") & ~late, "pending").otherwise("failed")
    return last.select("session", "call", outcome.alias("outcome"), F.col("m.at").alias("at"), F.col("m.kept_out").alias("kept_out"))


def folded(markers: DataFrame, now: float, days: int = FOLD_DAYS) -> tuple[DataFrame, DataFrame]:
    """Old markers as one row for each session (done, failed, kept_out by name), and the younger ones as they are; together they say the same."""
    rows = settled(markers, now)
    old = rows.filter((F.lit(now) - F.col("at") > days * 86_400) & (F.col("outcome") != "pending"))
    names = old.filter("outcome = 'done'").select("session", F.explode("kept_out").alias("name", "n")).groupBy("session", "name").agg(F.sum("n").alias("n"))
    kept = names.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("kept_out"))
    ids = lambda o: F.array_sort(F.collect_set(F.when(F.col("outcome") == o, F.col("call")))).alias(o)
    return old.groupBy("session").agg(ids("done"), ids("failed")).join(kept, "session", "left"), rows.join(old.select("session", "call"), ["session", "call"], "left_anti")


def uncleaned(uses: DataFrame, results: DataFrame, markers: DataFrame, covered: tuple[str, ...], now: float) -> DataFrame:
    """session, call of results (session, call, is_error) of covered tools' calls (session, call, tool) that no done marker speaks for; a failed call is never cleaned and does not count."""
    done = settled(markers, now).filter("outcome = 'done'").select("session", "call")
    mine = uses.filter(F.col("tool").isin(*covered)).select("session", "call").distinct()
    return results.filter("NOT coalesce(is_error, false)").join(mine, ["session", "call"], "left_semi").select("session", "call").distinct().join(done, ["session", "call"], "left_anti")


def stream(events: DataFrame) -> DataFrame:
    """Events (session, call, kind: use, pending, done, failed or result; at) to an outcome for each result: cleaned, or not.

    A result waits for its marker as long as a marker may take; a timer then says that it was not cleaned.
    """

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, marker, at = state.get if state.exists else (False, "", 0.0)
        if state.hasTimedOut:
            state.remove()
            if waiting:
                yield pd.DataFrame([(key[0], key[1], "not_cleaned")], columns=["session", "call", "outcome"])
            return
        for pdf in batches:
            for kind, when in pdf.sort_values(["at", "kind"])[["kind", "at"]].itertuples(index=False):
                waiting = waiting or kind == "result"
                marker = kind if kind in ("pending", "done", "failed") else marker
                at = max(at, float(when))
        if waiting and marker in ("done", "failed"):
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], key[1], "cleaned" if marker == "done" else "not_cleaned")], columns=["session", "call", "outcome"])
            return
        state.update((waiting, marker, at))
        state.setTimeoutDuration(TIMEOUT_S * 1000)

    rows = events.filter("kind <> 'use'").select("session", "call", "kind", "at")
    return rows.groupBy("session", "call").applyInPandasWithState(one, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def tails(files: DataFrame, now: float) -> DataFrame:
    """Files (file, data, modified) with how far they can be read: whole lines; an open last line only once nobody writes it any more.

    Adds read (bytes) and why the rest is not: being_written. A line too long to be searched at once is partly_checked.
    """
    ends = F.octet_length("data") - F.octet_length(F.expr("substring_index(cast(data AS string), '\\n', -1)"))
    open_ = ends < F.octet_length("data")
    fresh = open_ & (F.lit(now) - F.col("modified") < FRESH_S)
    longest = F.array_max(F.transform(F.split(F.col("data").cast("string"), "\n"), F.octet_length))
    return files.withColumn("read", F.when(fresh, ends).otherwise(F.octet_length("data"))).withColumn("why", F.when(fresh, "being_written").when(longest > LONG, "partly_checked"))


def restart(steps: DataFrame) -> DataFrame:
    """Steps (file, step, format or null) with `use`: those before a file's format was learnt are read again in it."""
    learnt = F.first("format", ignorenulls=True).over(W.partitionBy("file").orderBy("step").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    first = F.min(F.when(F.col("format").isNotNull(), F.col("step"))).over(W.partitionBy("file"))
    return steps.withColumn("use", F.coalesce(learnt, F.lit("unknown"))).withColumn("again", F.coalesce(F.col("step") < first, F.lit(False)))


def direct_by_flow(attempts: DataFrame) -> DataFrame:
    """Connections past the sinks (flow, protocol, target): how often each flow tried each."""
    return attempts.groupBy("flow", "protocol", "target").agg(F.count(F.lit(1)).alias("attempts"))
