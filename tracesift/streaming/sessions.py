"""Incremental sessions: the same answers as the batch operators, batch by batch, from checkpointed state.

Each conversation's state is what its tally needs and no more: how many messages, prompts and characters, and
the values seen. Emitting in update mode after each micro-batch gives, for the last state of each conversation,
what `operators.sessions.tallies` computes over all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "conv_id long, messages long, prompts long, chars long, values_seen long"
_STATE = "messages long, prompts long, chars long, seen array<string>"


def _tally(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    messages, prompts, chars, seen = state.get if state.exists else (0, 0, 0, [])
    values = set(seen)
    for pdf in batches:
        messages += len(pdf)
        prompts += int((pdf["role"] == "user").sum())
        chars += int(pdf["chars"].sum())
        for found in pdf["found"]:
            values.update(found)
    state.update((messages, prompts, chars, sorted(values)))
    yield pd.DataFrame({"conv_id": [key[0]], "messages": [messages], "prompts": [prompts], "chars": [chars], "values_seen": [len(values)]})


def tally(messages: DataFrame, pattern: str) -> DataFrame:
    """A stream of messages to a stream of tallies, one row for each conversation that a micro-batch touched."""
    rows = messages.select("conv_id", "role", F.length("text").cast("long").alias("chars"), F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("found"))
    return rows.groupBy("conv_id").applyInPandasWithState(_tally, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def read(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Files that land in a folder, some at a time; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed(hits: DataFrame, time: str, minutes: int = 10, late: str = "1 hour") -> DataFrame:
    """Hits for each tumbling window and type, final once the watermark has passed: for a live view."""
    w = F.window(time, f"{minutes} minutes")
    return hits.withWatermark(time, late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("hits")).select(F.col("window.start").alias("start"), "event_type", "hits")
