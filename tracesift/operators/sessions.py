"""Sessions: turns, first hits, tallies; spans that overlap; names that would show a value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def turns(messages: DataFrame) -> DataFrame:
    """Adds the number of prompts up to each message."""
    order = W.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(W.unboundedPreceding, W.currentRow)
    return messages.withColumn("prompt_no", F.sum((F.col("role") == "user").cast("int")).over(order))


def tallies(messages: DataFrame, pattern: str) -> DataFrame:
    """For each conversation: messages, prompts, characters, values that look like `pattern`, and in which turn first."""
    found = F.regexp_extract_all("text", F.lit(pattern), 0)
    rows = turns(messages).withColumn("values", F.array_distinct(found))
    return rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.max("prompt_no").alias("prompts"), F.sum(F.length("text")).alias("chars"),
        F.size(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values_seen"), F.min(F.when(F.size("values") > 0, F.col("prompt_no"))).alias("first_turn"),
    )


def islands(spans: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping spans as one: gaps and islands by the running maximum of ends."""
    order = W.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)
    island = F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = spans.withColumn("opens", opens).withColumn("island", island)
    return rows.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("spans")).drop("island")


def owners(shapes: DataFrame, assignments: DataFrame, by: list[str]) -> DataFrame:
    """Each shape with the first assignment whose span overlaps it."""
    a = assignments.select(*by, F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("name"))
    rows = shapes.join(a, by, "left").withColumn("over", (F.col("start") < F.col("a_end")) & (F.col("a_start") < F.col("end")))
    first = F.min(F.when(F.col("over"), F.struct("a_start", "name")))
    return rows.groupBy(*by, "start", "end").agg(first["name"].alias("owner"))


def grams(text, n: int = 6):
    """All runs of n characters, each once."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substring(text, k, F.lit(n))))).otherwise(F.expr("cast(array() AS array<string>)"))


def withheld(names: DataFrame, values: DataFrame, n: int = 6) -> DataFrame:
    """Names, shown as [withheld] where they hold any run of n characters of a value: an n-gram semi join."""
    shown = names.select("name").distinct()
    pieces = shown.select("name", F.explode(grams(F.col("name"), n)).alias("g"))
    secret = values.select(F.explode(grams(F.col("value"), n)).alias("g")).distinct()
    held = pieces.join(secret, "g", "left_semi").select("name").distinct().withColumn("held", F.lit(True))
    return shown.join(held, "name", "left").select(F.when(F.col("held"), "[withheld]").otherwise(F.col("name")).alias("shown"))
