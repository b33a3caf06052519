"""Whole analyses: a telemetry folder to findings and coverage, a ledger and a capture to a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.catalog import Catalog
from tracesift.lineage import kept
from tracesift.operators import evaluate, exposure, judge, requests, taint, trace
from tracesift.sources import captures, lines, otlp, surface


def scan(spark: SparkSession, folder: str, catalog: Catalog | None = None, framework: str | None = None) -> dict[str, DataFrame]:
    """nodes, joins, gauge, flows, findings, exposures (graded by rules), hits, ledger and unread of one telemetry folder.

    Exposure reads spans that flows do not. Whoever decides by the findings must look at `unread` too: `evaluate.exit_code`.
    """
    catalog = catalog or Catalog()
    # kept while the results that share them are written: files are read once for flows and once for exposure
    spans = kept(otlp.read_spans(spark, folder))
    nodes = kept(otlp.nodes(spans))
    keyed = nodes.withColumn("trace_id", F.xxhash64("trace_id"))
    resolved = kept(trace.resolve(keyed))
    # a join that touches a span id of differing spans picks one of them in silence: it is named, not used
    twins = keyed.filter("twin").select("trace_id", "idx")
    joins = resolved.filter("result_idx IS NOT NULL")
    for end in ("call_idx", "result_idx"):
        joins = joins.join(twins.select((F.col("trace_id") + 0).alias("trace_id"), F.col("idx").alias(end)), ["trace_id", end], "left_anti")
    joins = kept(joins.select("trace_id", "call_idx", "result_idx", "confidence"))
    found = kept(surface.read(spark, folder))
    texts = F.when(F.col("header").isNull(), F.col("text")).otherwise(F.concat_ws(": ", "header", "text"))
    strings = found.filter("unread IS NULL").select(F.concat_ws(":", "file", "signal", "path").alias("surface"), F.concat_ws(":", "line", "record").alias("record"), texts.alias("text"))
    hits = exposure.graded(exposure.subsumed(exposure.settled(exposure.candidates(strings, tuple(c for c in catalog.classes if c.exposure)))))
    flows = kept(taint.provenance(keyed, joins, catalog.sinks))
    exact = kept(taint.matched(taint.eligible_labels(keyed, catalog.classes), keyed, joins, catalog.sinks))
    findings = evaluate.flow_findings(spark, keyed, joins, exact, taint.untrusted(flows, catalog.untrusted), catalog.rules)
    scopes = spans.filter("scope IS NOT NULL").groupBy(F.xxhash64("trace_id").alias("trace_id")).agg(F.min_by("scope", F.struct("start_nanos", "span_id")).alias("scope"))
    gauge = evaluate.remediation(trace.ladder(trace.gauge(keyed, joins)).join(scopes, "trace_id", "left"), catalog.scope_remediations, catalog.remediations, framework)
    noted = otlp.ledger(spans, nodes).unionByName(resolved.filter("result_idx IS NULL").groupBy(F.col("confidence").alias("reason"), F.concat_ws(":", "trace_id", "call_idx").alias("subject")).agg(F.count(F.lit(1)).alias("n")))
    return {
        "nodes": nodes, "joins": joins, "gauge": gauge, "flows": flows, "findings": findings, "hits": hits, "exposures": evaluate.exposure_findings(spark, hits, catalog.rules),
        "ledger": noted, "unread": found.filter("unread IS NOT NULL").select("file", "line", "signal", "path", "unread"),
    }


failing = evaluate.failing


def judge_capture(spark: SparkSession, ledger_path: str, folder: str, requests_path: str | None = None) -> dict[str, DataFrame]:
    """Hits, states, reasons, coverage, blocked destinations and verdict of a ledger's values over a folder and captured requests.

    Every listed file is read or named: compressed files, links and folders that cannot be read are reasons why the
    answer is incomplete, and so are lines that are no JSON (they are searched raw), texts escaped deeper than views
    go, flows that failed, required placements that nothing exercised, and connections past the sinks.
    """
    ledger = captures.records(spark, ledger_path)
    placed = captures.placements(ledger)
    listed = lines.files(spark, folder)
    numbered = lines.lines(listed)
    walked = lines.walked(numbered)
    strings = walked.filter("unread IS NULL").select(F.concat_ws(":", "file", "path").alias("surface"), F.col("line").alias("record"), "text")
    broken = walked.filter("unread IS NOT NULL").select("file", "line", F.col("unread").alias("why"))
    raw = numbered.join(broken, ["file", "line"], "left_semi").select(F.col("file").alias("surface"), F.col("line").alias("record"), F.col("data").cast("string").alias("text"))
    needles = judge.needle_table(placed)
    hits, deep = judge.find_viewed(spark, strings.unionByName(raw), needles)
    reasons = [
        lines.unscanned(spark, folder, listed).select(F.lit("not_scanned").alias("reason"), F.concat(F.col("file"), F.lit(" ("), F.col("why"), F.lit(")")).alias("subject")),
        broken.select(F.lit("unparsed_record").alias("reason"), F.concat_ws(":", "file", "line").alias("subject")),
        deep.select(F.lit("unparsed_record").alias("reason"), F.concat_ws(":", "surface", "record").alias("subject")),
        captures.violations(ledger).select(F.lit("unreadable_ledger").alias("reason"), F.concat_ws(":", "subject", "reason").alias("subject")),
        judge.empty_capture(strings),
    ]
    evidence = captures.exercised(ledger)
    sent = None
    if requests_path is not None:
        sent = requests.judged(spark, captures.requests(spark, requests_path), placed, needles)
        hits = hits.unionByName(sent["hits"].select(F.concat_ws(":", F.lit("request"), "location").alias("surface"), F.col("request").alias("record"), "placement", "form"))
        evidence = evidence.unionByName(sent["evidence"])
        reasons.append(sent["unread"].select(F.lit("unparsed_record").alias("reason"), F.concat(F.lit("request:"), F.col("request").cast("string")).alias("subject")))
    states = judge.placement_states(placed, hits, evidence)
    reasons += judge.ledger_reasons(ledger, states)
    why = reasons[0]
    for more in reasons[1:]:
        why = why.unionByName(more)
    why = why.distinct()
    out = {"hits": hits, "states": states, "reasons": why, "verdict": judge.decided(states, why), "violations": captures.violations(ledger), "coverage": judge.coverage(states, strings, listed, why)}
    return out | ({"requests": sent["attributed"], "blocked": sent["blocked"]} if sent else {})


__all__ = ["failing", "judge_capture", "scan"]
