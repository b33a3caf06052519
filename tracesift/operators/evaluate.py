"""Rules over what was found: findings with their severity, and why one is no verdict.

A flow is a verdict only if no node on its witness path is degraded, no join on it is weaker than nesting, and its
rule is active. An exposure is one only if the value clears its class's floor and the rule is active. Rules are a few
rows and are joined as such. A flow that a verbatim rule reports is not reported again as provenance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.catalog import SEVERITIES, Rule
from tracesift.operators import taint

_FINDING = ["trace_id", "source_idx", "sink_idx", "rule_id", "kind", "rule_version", "severity", "value", "path", "reasons", "is_verdict_grade"]


def rule_table(spark: SparkSession, rules: tuple[Rule, ...], mode: str) -> DataFrame:
    """The rules of a mode. Of flow rules that name the same source and sink the last by id counts."""
    rows = [(r.id, r.version, r.stage, r.source_class, r.sink, r.severity) for r in sorted(rules, key=lambda r: r.id) if r.mode == mode]
    if mode != "exposure":
        rows = list({(r[3] if mode == "verbatim" else None, r[4]): r for r in rows}.values())
    return spark.createDataFrame(rows, "rule_id string, rule_version string, stage string, class string, sink string, severity string")


def reasons():
    """Why a flow is no verdict, in the order in which reports name them."""
    weak = F.concat(F.lit("non-verdict join tier on witness path: "), F.array_join("tiers", ","))
    stage = F.concat(F.lit("rule stage is '"), F.col("stage"), F.lit("', not active"))
    return F.array_compact(F.array(F.when(F.col("degraded"), "degraded node on witness path"), F.when(F.size("tiers") > 0, weak), F.when(F.col("stage") != "active", stage)))


def flow_findings(spark: SparkSession, nodes: DataFrame, joins: DataFrame, verbatim: DataFrame, flows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of verbatim matches (trace_id, source_idx, sink_idx, sink, class, value) and provenance flows.

    Ordered by trace, source, sink, rule and kind where it is written out. Paths are searched once for both kinds.
    """
    rule = ["rule_id", "rule_version", "stage", "severity"]
    keys = ["trace_id", "source_idx", "sink_idx", "value"]
    exact = verbatim.join(F.broadcast(rule_table(spark, rules, "verbatim")), ["class", "sink"]).select(*keys, *rule, F.lit("verbatim").alias("kind"))
    rest = flows.withColumnsRenamed({"result_idx": "source_idx", "token": "value"}).join(exact.select("trace_id", "sink_idx", "value").distinct(), ["trace_id", "sink_idx", "value"], "left_anti")
    loose = rest.join(F.broadcast(rule_table(spark, rules, "provenance").drop("class")), "sink").select(*keys, *rule, F.lit("provenance").alias("kind"))
    matches = exact.unionByName(loose)
    rows = matches.join(taint.witness(nodes, joins, matches), ["trace_id", "source_idx", "sink_idx"])
    return rows.withColumn("reasons", reasons()).withColumn("is_verdict_grade", F.size("reasons") == 0).select(*_FINDING)


def exposure_findings(spark: SparkSession, hits: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A finding for each hit (graded) and each exposure rule of its class."""
    rows = hits.withColumnRenamed("is_verdict_grade", "eligible").join(F.broadcast(rule_table(spark, rules, "exposure").drop("sink")), "class")
    shape = F.when(~F.col("eligible"), F.concat(F.lit("value shape not eligible for "), F.col("class")))
    stage = F.when(F.col("stage") != "active", F.concat(F.lit("rule "), F.col("rule_id"), F.lit(" is in stage '"), F.col("stage"), F.lit("', not active")))
    rows = rows.withColumn("reasons", F.array_compact(F.array(shape, stage)))
    return rows.withColumn("is_verdict_grade", F.size("reasons") == 0).drop("stage", "eligible")


def failing(findings: DataFrame, threshold: str = "low") -> DataFrame:
    """Findings of either family that fail a run: verdicts at least as severe as the threshold."""
    return findings.filter(F.col("is_verdict_grade") & F.col("severity").isin(*SEVERITIES[SEVERITIES.index(threshold) :]))


def exit_code(found: DataFrame, exposures: DataFrame, unread: DataFrame, threshold: str = "low") -> int:
    """0 clean, 1 a failing finding, 3 none but something was not read."""
    if not failing(found, threshold).isEmpty() or not failing(exposures, threshold).isEmpty():
        return 1
    return 0 if unread.isEmpty() else 3


def summary(hits: DataFrame) -> DataFrame:
    """For each grade: distinct values, places, records and classes of the exposures."""
    grade = F.when(F.col("is_verdict_grade"), "credential").otherwise("review").alias("grade")
    return hits.groupBy(grade).agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct("fingerprint").alias("values_seen"), F.countDistinct("surface").alias("places"),
        F.countDistinct("surface", "record").alias("records"), F.array_join(F.array_sort(F.collect_set("class")), ", ").alias("classes"),
    )


def pairs(flows: DataFrame, sinks: tuple[str, ...]) -> DataFrame:
    """Flows by origin and sink: how many, and how many could be attributed to a tool."""
    rows = flows.filter(F.col("sink").isin(*sinks)) if sinks else flows.limit(0)
    label = F.concat(F.coalesce("origin", F.lit("unknown")), F.lit("->"), F.col("sink")).alias("pair")
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("flows"), F.count("origin").alias("attributable"))


def remediation(report: DataFrame, scopes: dict[str, str], frameworks: dict[str, str], framework: str | None = None) -> DataFrame:
    """Adds what to change where arguments are not captured: by the scope that the telemetry names, else by the framework."""
    by_scope = F.create_map(*[F.lit(x) for kv in scopes.items() for x in kv])[F.col("scope")] if scopes else F.lit(None).cast("string")
    advice = F.coalesce(by_scope, F.lit(frameworks.get(framework or "")))
    return report.withColumn("remediation", F.when(F.col("inspectable_bp") < 10000, advice))
