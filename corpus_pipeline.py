"""The corpus pipeline: each stage is one training-data operator over what the stage before kept.

Toxic documents go; of near-duplicates one stays; passages of test items are cut out, and documents that are
mostly such passages go; personal data are replaced; what is left is packed into sequences. All stages but
the last return the columns of documents, with n_chars kept true to the text.

Defined cases: a null or empty text is clean and a copy of every other such text, and packs as the end id alone; rows
that share a doc_id are told apart by their texts, and equal rows are one; of a group of near copies the smallest doc_id
stays, then the smallest text key; texts of any length are read whole; columns whose names clash with the operators'
own are kept; empty documents, labels or test items leave a stage with nothing to do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.llm import decontamination, packing, pii, similar, toxicity
from tracesift.llm.common import Scratch, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(spark, docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontamination.remove(spark, docs, table(spark, sf_dir, "benchmark")))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.sanitise(spark, docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("pii", sanitise),
    ("best-fit packing", pack),
]

#: A fitted model, fingerprints and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
