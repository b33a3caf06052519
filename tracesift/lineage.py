"""Results that several others are made of: written once, so that neither jobs nor plans grow with each use."""

from __future__ import annotations

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that spark.checkpoint.dir names, which survives lost executors; without one, a cached table."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()
