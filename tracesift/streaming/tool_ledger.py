"""Tool calls issued to an agent against results it sent back, in order, flow by flow.

An issued call waits, first in first out by tool. A result that names a waiting call executes it; one for a call
executed before is a retry and changes nothing; one for a call never issued is unmediated. Works on a stream
(state by flow) and on a table (rows by flow in order) with the same step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "flow long, seq long, tool string, verdict string"
_STATE = "open array<string>, done array<string>"


def step(waiting: list[str], done: set[str], kind: str, tool: str, call: str) -> str | None:
    """Takes one record; the verdict of a result, or None for an issued call. `waiting` holds 'tool call' pairs."""
    mark = f"{tool}\t{call}"
    if kind == "call":
        waiting.append(mark)
        return None
    if mark in waiting:
        waiting.remove(mark)
        done.add(mark)
        return "executed"
    if mark in done:
        return "retry"
    same = next((w for w in waiting if w.split("\t")[0] == tool), None)
    if same is not None:  # another id for the oldest waiting call of the tool
        waiting.remove(same)
        done.add(mark)
        return "mismatch"
    return "unmediated"


def _rows(flow: int, pdf: pd.DataFrame, waiting: list[str], done: set[str]) -> list[tuple]:
    out = []
    for seq, kind, tool, call in pdf.sort_values("seq")[["seq", "kind", "tool", "call"]].itertuples(index=False):
        verdict = step(waiting, done, kind, tool, call)
        if verdict is not None:
            out.append((flow, seq, tool, verdict))
    return out


def batch(records: DataFrame) -> DataFrame:
    """flow, seq, kind (call or result), tool, call -> a verdict for each result."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_rows(pdf["flow"].iloc[0], pdf, [], set()), columns=["flow", "seq", "tool", "verdict"])

    return records.select("flow", "seq", "kind", "tool", "call").groupBy("flow").applyInPandas(one, _OUT)


def stream(records: DataFrame) -> DataFrame:
    """The same on a stream whose micro-batches bring each flow's records in order."""

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, done = (list(x) for x in (state.get if state.exists else ([], [])))
        known = set(done)
        rows = _rows(key[0], pd.concat(list(batches)), waiting, known)
        state.update((waiting, sorted(known)))
        yield pd.DataFrame(rows, columns=["flow", "seq", "tool", "verdict"])

    return records.select("flow", "seq", "kind", "tool", "call").groupBy("flow").applyInPandasWithState(one, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
