"""The analyser's queries over the driver tables, by name, with the SQL that returns the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.catalog import CLASSES, HEX_SERVICE_TOKEN, Rule, SourceClass
from tracesift.functions import eligibility, names
from tracesift.lineage import kept
from tracesift.operators import audit, evaluate, exposure, facts, judge, sessions, taint, trace
from tracesift.sources.driver_tables import NODES_SQL, PLACEMENTS_SQL, SURFACES_SQL, event_nodes, message_nodes, placements, surfaces, table

#: Classes whose patterns mean the same to the SQL engine's regexes.
_FIELD = SourceClass("credential_field", r"(?i)(?:secret|token|password|passwd)[ \t]*[=:][ \t]*\"?([^\"'\s,;)}]{8,256})", None, None, ("[*xX#]+",), 1)
SIMPLE: tuple[SourceClass, ...] = (HEX_SERVICE_TOKEN, _FIELD)
_TOKEN = r"item[0-9]+-user[0-9]+"


def canonical_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_nodes(spark, sf_dir).select("trace_id", F.col("idx").cast("long").alias("idx"), "kind", F.col("content_chars").cast("long").alias("content_chars"))


def surface_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = surfaces(spark, sf_dir)
    return s.groupBy("surface").agg(F.count("text").alias("strings"), F.count_if(F.col("text").isNull()).alias("unread"), F.sum(F.length("text")).cast("long").alias("chars"), F.countDistinct("text").alias("distinct_strings"))


def label_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = surfaces(spark, sf_dir).filter(F.col("text").rlike("[0-9a-f]{40}"))
    rows = docs.select("surface", "record", F.posexplode(F.regexp_extract_all("text", F.lit("[0-9a-f]{40}"), 0)).alias("pos", "value"))
    return rows.groupBy("surface", "record", F.substring(F.sha2("value", 256), 1, 12).alias("fingerprint")).agg(F.min("pos").cast("long").alias("first_pos"))


def eligibility_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = surfaces(spark, sf_dir).filter("surface = 'documents.text'")
    rows = s.select("record", F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z]{4,}[-_][A-Za-z0-9_-]{4,40}|[0-9a-f]{40}"), 0)).alias("v")).distinct()
    rest = F.substring("v", F.length(eligibility.floor_prefix(F.col("v"))) + 1, F.length("v"))
    return rows.groupBy(eligibility.floor_prefix(F.col("v")).alias("prefix"), eligibility.distinct_characters(rest).cast("long").alias("distinct_chars"), eligibility.eligible(F.col("v"), HEX_SERVICE_TOKEN).alias("eligible")).agg(F.count(F.lit(1)).alias("n"))


def simple_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.graded(exposure.subsumed(exposure.settled(exposure.candidates(surfaces(spark, sf_dir), SIMPLE))))


def exposure_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_findings(spark, sf_dir).withColumns({"start": F.col("start").cast("long"), "value_len": F.col("value_len").cast("long")})


def exposure_by_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.by_fingerprint(simple_findings(spark, sf_dir)).withColumn("ordinal", F.col("ordinal").cast("long"))


def exposure_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bundled classes that belong to the exposure scan, over all surfaces."""
    hits = exposure.graded(exposure.subsumed(exposure.settled(exposure.candidates(surfaces(spark, sf_dir), (*(c for c in CLASSES if c.exposure), HEX_SERVICE_TOKEN)))))
    return hits.withColumns({"start": F.col("start").cast("long"), "value_len": F.col("value_len").cast("long")})


def event_trace(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and joins, kept while a query's several branches read them."""
    nodes = kept(event_nodes(spark, sf_dir))
    return nodes, kept(trace.resolve(nodes).filter("result_idx IS NOT NULL"))


def join_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    joins = trace.resolve_sets(event_nodes(spark, sf_dir))
    return joins.select("trace_id", F.col("call_idx").cast("long").alias("call_idx"), F.col("result_idx").cast("long").alias("result_idx"), "confidence")


def join_resolution_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    joins = trace.resolve(event_nodes(spark, sf_dir))
    return joins.select("trace_id", F.col("call_idx").cast("long").alias("call_idx"), F.col("result_idx").cast("long").alias("result_idx"), "confidence")


def gauge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.ladder(trace.gauge(*event_trace(spark, sf_dir)))


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.reachable(*event_trace(spark, sf_dir)).select("trace_id", F.col("idx").cast("long").alias("idx"), F.col("lo").cast("long").alias("lo"))


def provenance_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taint.provenance(*event_trace(spark, sf_dir))
    return rows.select("trace_id", F.col("result_idx").cast("long").alias("result_idx"), F.col("sink_idx").cast("long").alias("sink_idx"), "sink", "token", "origin")


def provenance_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = taint.provenance(*event_trace(spark, sf_dir))
    return flows.groupBy(F.concat(F.coalesce("origin", F.lit("unattributed")), F.lit("->"), F.col("sink")).alias("pair")).agg(F.count(F.lit(1)).alias("flows"), F.countDistinct("trace_id").alias("traces"))


def verbatim_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taint.verbatim(*event_trace(spark, sf_dir), _TOKEN)
    return rows.select("trace_id", F.col("source_idx").cast("long").alias("source_idx"), F.col("sink_idx").cast("long").alias("sink_idx"), "sink", eligibility.fingerprint(F.col("value")).alias("fingerprint"))


_RULES = (Rule("item-to-mail", "verbatim", "item_value", "send_email"), Rule("item-to-webhook", "verbatim", "item_value", "post_to_webhook", "medium", stage="draft"), Rule("any-to-webhook", "provenance", None, "post_to_webhook", "low"))


def flow_findings_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over flows: severity, and every reason why one is no verdict."""
    nodes, joins = event_trace(spark, sf_dir)
    exact = taint.verbatim(nodes.filter("trace_id % 2 = 0"), joins, _TOKEN).withColumn("class", F.lit("item_value"))
    rows = evaluate.flow_findings(spark, nodes, joins, exact, taint.provenance(nodes, joins), _RULES)
    places = [F.col(c).cast("long").alias(c) for c in ("source_idx", "sink_idx")]
    return rows.select("trace_id", *places, "rule_id", "kind", "severity", F.array_join("path", ",").alias("path"), F.array_join("reasons", "; ").alias("reasons"), "is_verdict_grade")


def witness_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, joins = event_trace(spark, sf_dir)
    rows = taint.witness(nodes, joins, taint.verbatim(nodes, joins, _TOKEN))
    return rows.select("trace_id", F.col("source_idx").cast("long").alias("source_idx"), F.col("sink_idx").cast("long").alias("sink_idx"), F.col("steps").cast("long").alias("steps"))


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).filter("surface IN ('pages.html', 'documents.text')")


def needle_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge.find(spark, capture(spark, sf_dir), judge.needle_table(placements(spark, sf_dir)), ("raw",))
    return found.select("surface", "record", "placement", "form")


def needle_hits_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture spelled in hex: only the hex needles hit it, and base64 ones when it is spelled so."""
    part = capture(spark, sf_dir)
    spelled = part.withColumn("text", F.lower(F.hex(F.col("text").cast("binary")))).withColumn("surface", F.concat("surface", F.lit(".hex")))
    other = part.withColumn("text", F.regexp_replace(F.base64(F.col("text").cast("binary")), "\r\n", "")).withColumn("surface", F.concat("surface", F.lit(".base64")))
    found = judge.find(spark, spelled.unionByName(other), judge.needle_table(placements(spark, sf_dir)))
    return judge.first_forms(found)


def placement_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placements(spark, sf_dir)
    pages = surfaces(spark, sf_dir).filter("surface = 'pages.html'")
    found = judge.first_forms(judge.find(spark, pages, judge.needle_table(p), ("raw", "json", "url", "hex")))
    return judge.states(p, found, p.filter("placement < '8'"))


def judge_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    unread = surfaces(spark, sf_dir).filter("text IS NULL")
    return judge.verdict(placement_states(spark, sf_dir), unread)


def request_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"\?([^#]*)", 1).alias("query"))
    pair = F.explode(F.filter(F.split("query", "&"), lambda x: x != "")).alias("pair")
    return rows.select("page_id", "host", pair).select("page_id", "host", F.regexp_extract("pair", "^([^=]*)", 1).alias("name"), F.regexp_extract("pair", "=(.*)$", 1).alias("value"))


KEY = b"a key for comparing runs, not a secret"


def audit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("surface") == "pages.html", "tool_call").when(F.col("surface") == "conversations.text", "context").otherwise("stored")
    places = surfaces(spark, sf_dir).filter("surface IN ('pages.html', 'documents.text', 'conversations.text')").select("record", kind.alias("kind"), "text")
    stored = audit.fingerprints(placements(spark, sf_dir).withColumnRenamed("placement", "credential"), KEY)
    return audit.states(stored, audit.hits(spark, places, stored, KEY))


def turn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.turns(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", "role", F.col("prompt_no").cast("long").alias("prompt_no"))


def session_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.tallies(table(spark, sf_dir, "conversations"), "[A-Z][a-z]{6,}")
    return rows.select("conv_id", *[F.col(c).cast("long").alias(c) for c in ("messages", "prompts", "chars", "values_seen", "first_turn")])


def span_merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("long").alias("start"), (F.col("event_id") + F.get_json_object("props", "$.k").cast("long") * 3).alias("end"))
    return sessions.islands(e, ["user_id"])


def span_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").cast("long").alias("start"), (F.col("event_id") + F.get_json_object("props", "$.k").cast("long") * 3).alias("end"))
    return sessions.owners(e.filter("event_type = 'error'").drop("event_type"), e.filter("event_type = 'click'").withColumn("name", F.concat(F.lit("click"), F.col("start").cast("string"))), ["user_id"])


def withheld_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "pages").select(F.regexp_extract("html", "token = &quot;([0-9a-f]{40})", 1).alias("name")).filter("name <> ''")
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("name"))
    return sessions.withheld(named.unionByName(hosts), placements(spark, sf_dir)).groupBy("shown").agg(F.count(F.lit(1)).alias("names"))


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of five runs: which user kind did what at which tool, with the mode and witness it showed."""
    nodes = event_nodes(spark, sf_dir)
    rows = nodes.filter("kind = 'tool_call'").withColumns({"run": F.col("trace_id") % 5, "bucket": (F.col("call_id").cast("int") % 12).cast("long")})
    mode = F.when(F.col("node_id") % 3 == 0, "verbatim").otherwise("provenance")
    confidence = F.when(F.col("degraded"), "heuristic").when(F.col("parent_id").isNotNull(), "nested").otherwise("explicit")
    return rows.select("run", "tool_name", "bucket", mode.alias("mode"), confidence.alias("confidence"), F.array(F.concat(F.lit("r"), F.col("idx").cast("string"))).alias("roles"), F.array(F.col("node_id"), F.col("node_id") + F.col("idx")).alias("witness"))


IDENTITY = ["tool_name", "bucket"]


def fact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.merge(event_facts(spark, sf_dir), IDENTITY)
    return rows.select(*IDENTITY, "mode", F.size("roles").cast("long").alias("n_roles"), "confidence", F.element_at("witness", 1).alias("witness_first"), "observations")


def required_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.baseline(event_facts(spark, sf_dir).filter("bucket < 11 OR run < 2"), IDENTITY).select(*IDENTITY, F.col("mode_rank").cast("long").alias("mode_rank"), "required")


def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_facts(spark, sf_dir)
    base = facts.baseline(f.filter("run < 4 AND NOT (tool_name = 'send_email' AND bucket = 3) AND (mode = 'provenance' OR bucket > 2)"), IDENTITY)
    return facts.differences(base, f.filter("run = 4 AND bucket <> 7"), IDENTITY)


def name_suggests_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of two words of the schema: a rule over their words."""
    words = spark.createDataFrame([(w,) for w in ("client", "api", "public", "token", "key", "user", "password", "n", "ssh", "keys")], "w string")
    pairs = words.select(F.col("w").alias("a")).join(words.select(F.col("w").alias("b")), F.col("a") != F.col("b")).select(F.concat_ws("_", F.upper("a"), F.upper("b")).alias("name"))
    return pairs.select("name", names.suggests_secret(names.name_words(F.col("name"))).alias("secret"))


def env_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query parameters and document assignments judged as environment entries."""
    assigned = table(spark, sf_dir, "documents").filter(F.col("text").contains("token")).select(F.explode(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})"'), 1)).alias("value")).withColumn("name", F.lit("SERVICE_TOKEN"))
    rows = request_parts(spark, sf_dir).select("name", "value").unionByName(assigned.select("name", "value"))
    return rows.withColumn("c", names.classify(F.col("name"), F.col("value"))).groupBy(F.col("c.verdict").alias("verdict"), F.col("c.why").alias("why")).agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        canonical_nodes, surface_strings, label_sources, eligibility_floor, exposure_hits, exposure_by_fingerprint, exposure_catalog, join_resolution, join_resolution_exact, gauge_report,
        reachability, provenance_flows, provenance_gauge, verbatim_matches, flow_findings_graded, witness_paths, needle_hits, needle_hits_encoded, placement_states, judge_verdict, request_parts,
        audit_states, turn_numbers, session_tallies, span_merge_islands, span_owners, withheld_names, fact_merge, required_allowed, baseline_delta, name_suggests_secret, env_classify,
    )
}

_SETS = f"{NODES_SQL},{trace.JOINS_SQL}"
_JOINED = f"{NODES_SQL},{trace.EXACT_SQL}"
REACH_SQL = f"""{_JOINED},
reach(trace_id, idx, lo) AS (SELECT trace_id, idx, idx + 1 FROM nodes UNION SELECT r.trace_id, r.idx, least(r.lo, j.result_idx) FROM reach r JOIN joins j ON j.trace_id = r.trace_id AND (j.call_idx >= r.lo OR j.call_idx = r.idx) AND j.result_idx < r.lo),
reached AS (SELECT trace_id, idx, min(lo) AS lo FROM reach GROUP BY ALL),
sinks AS (SELECT trace_id, idx AS sink_idx, args, tool_name AS sink FROM nodes WHERE kind = 'tool_call' AND NOT degraded AND tool_name IN ('send_email', 'post_to_webhook'))"""
_FLOWS = f"""{REACH_SQL},
tokens AS (SELECT DISTINCT n.trace_id, n.idx AS result_idx, r.lo, unnest(regexp_extract_all(n.content, '[A-Za-z0-9][A-Za-z0-9._@+-]*')) AS token FROM nodes n JOIN reached r USING (trace_id, idx) WHERE n.kind = 'tool_result'),
flow AS (SELECT t.trace_id, t.result_idx, s.sink_idx, s.sink, min(t.token) AS token FROM tokens t JOIN sinks s ON s.trace_id = t.trace_id AND s.sink_idx >= t.lo AND contains(s.args, t.token)
  WHERE length(t.token) >= 8 AND NOT regexp_full_match(t.token, '[0-9]+') GROUP BY ALL),
origin AS (SELECT j.trace_id, j.result_idx, n.tool_name AS origin FROM (SELECT trace_id, result_idx, min(call_idx) AS idx FROM joins GROUP BY ALL) j JOIN nodes n USING (trace_id, idx)),
flows AS (SELECT flow.*, origin FROM flow LEFT JOIN origin USING (trace_id, result_idx))"""
_VERBATIM = f"""{REACH_SQL},
labels AS (SELECT DISTINCT n.trace_id, n.idx AS source_idx, r.lo, unnest(regexp_extract_all(n.content, '{_TOKEN}')) AS value FROM nodes n JOIN reached r USING (trace_id, idx) WHERE n.kind = 'tool_result'),
matches AS (SELECT l.trace_id, l.source_idx, s.sink_idx, s.sink, l.value FROM labels l JOIN sinks s ON s.trace_id = l.trace_id AND s.sink_idx >= l.lo
  AND contains(replace(replace(upper(s.args), ' ', ''), '-', ''), replace(replace(upper(l.value), ' ', ''), '-', '')))"""
EXPOSED_SQL = f"""{SURFACES_SQL},
hex AS (SELECT surface, record, 'hex_service_token' AS class, 0 AS rank, text, unnest(regexp_extract_all(text, '\\b[0-9a-f]{{40}}\\b')) AS value, unnest(range(1, len(regexp_extract_all(text, '\\b[0-9a-f]{{40}}\\b')) + 1)) AS k,
  string_split_regex(text, '\\b[0-9a-f]{{40}}\\b') AS p FROM surfaces WHERE regexp_matches(text, '\\b[0-9a-f]{{40}}\\b')),
fieldp AS (SELECT surface, record, text, regexp_extract_all(text, '(?i)(?:secret|token|password|passwd)[ \\t]*[=:][ \\t]*"?([^"''\\s,;)}}]{{8,256}})') AS w,
  regexp_extract_all(text, '(?i)(?:secret|token|password|passwd)[ \\t]*[=:][ \\t]*"?([^"''\\s,;)}}]{{8,256}})', 1) AS v,
  string_split_regex(text, '(?i)(?:secret|token|password|passwd)[ \\t]*[=:][ \\t]*"?[^"''\\s,;)}}]{{8,256}}') AS p FROM surfaces WHERE regexp_matches(text, '(?i)(?:secret|token|password|passwd)[ \\t]*[=:]')),
field AS (SELECT surface, record, p, w, v, unnest(range(1, len(w) + 1)) AS k FROM fieldp WHERE len(w) > 0),
cand AS (SELECT surface, record, class, rank, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + 40 * (k - 1) AS BIGINT) AS start, value,
    length(array_to_string(list_distinct(string_split(substr(value, 5), '')), '')) >= 8 AND NOT regexp_full_match(value, '0+') AS eligible FROM hex
  UNION ALL SELECT surface, record, 'credential_field', 1, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:k - 1], lambda x: length(x))), 0) + length(w[k]) - length(v[k]) AS BIGINT), v[k], false
    FROM field WHERE NOT regexp_full_match(v[k], '[*xX#]+')),
settled AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY surface, record, start ORDER BY rank) = 1),
hits AS (SELECT * FROM settled h WHERE h.eligible OR NOT EXISTS (SELECT 1 FROM settled i WHERE i.eligible AND i.surface = h.surface AND i.record = h.record AND i.class <> h.class AND h.start <= i.start AND i.start + length(i.value) <= h.start + length(h.value))),
findings AS (SELECT surface, record, class, start, length(value) AS value_len, CASE WHEN eligible THEN substr(value, 1, 4) END AS prefix, CASE WHEN eligible THEN substr(sha256(value), 1, 12) END AS fingerprint,
  CASE WHEN eligible AND length(value) >= 12 THEN right(value, 4) END AS last4, eligible AS is_verdict_grade FROM hits)"""
_STATES = f"""{PLACEMENTS_SQL},
found AS (SELECT placement, count(*) AS n_hits FROM (SELECT DISTINCT p.placement, g.page_id FROM placements p JOIN pages g ON contains(g.html, p.value) OR contains(g.html, hex(p.value)) OR contains(g.html, lower(hex(p.value)))) GROUP BY ALL),
states AS (SELECT p.placement, coalesce(n_hits, 0) AS n_hits, CASE WHEN n_hits > 0 THEN 'raw' ELSE '' END AS forms,
  CASE WHEN n_hits > 0 THEN 'leaked' WHEN p.placement < '8' THEN 'clean' ELSE 'unknown' END AS state FROM placements p LEFT JOIN found USING (placement))"""
_SPANS = "s AS (SELECT user_id, event_type, event_id AS start, event_id + CAST(json_extract_string(props, '$.k') AS BIGINT) * 3 AS \"end\" FROM events)"
FACTS_SQL = f"""{NODES_SQL},
facts AS (SELECT trace_id % 5 AS run, tool_name, CAST(call_id AS BIGINT) % 12 AS bucket, CASE WHEN node_id % 3 = 0 THEN 'verbatim' ELSE 'provenance' END AS mode,
  CASE WHEN degraded THEN 'heuristic' WHEN parent_id IS NOT NULL THEN 'nested' ELSE 'explicit' END AS confidence, 'r' || idx AS role, node_id, idx FROM nodes WHERE kind = 'tool_call')"""
_MODE_RANK = "max(CASE mode WHEN 'verbatim' THEN 2 ELSE 1 END)"

ORACLE_SQL: dict[str, str] = {
    "canonical_nodes": "SELECT conv_id AS trace_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS idx, CASE role WHEN 'assistant' THEN 'llm_call' ELSE 'user_input' END AS kind, length(text) AS content_chars FROM conversations",
    "surface_strings": f"WITH {SURFACES_SQL} SELECT surface, count(text) AS strings, count(*) - count(text) AS unread, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT text) AS distinct_strings FROM surfaces GROUP BY surface",
    "label_sources": f"""WITH {SURFACES_SQL}, m AS (SELECT surface, record, regexp_extract_all(text, '[0-9a-f]{{40}}') AS v FROM surfaces WHERE regexp_matches(text, '[0-9a-f]{{40}}')),
      u AS (SELECT surface, record, unnest(v) AS value, unnest(range(0, len(v))) AS pos FROM m) SELECT surface, record, substr(sha256(value), 1, 12) AS fingerprint, min(pos) AS first_pos FROM u GROUP BY ALL""",
    "eligibility_floor": r"""WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z]{4,}[-_][A-Za-z0-9_-]{4,40}|[0-9a-f]{40}')) AS v FROM documents),
      p AS (SELECT v, CASE WHEN regexp_matches(substr(v, 1, 16), '[-_]') THEN regexp_extract(substr(v, 1, 16), '^.*[-_]') ELSE substr(v, 1, 4) END AS prefix FROM m),
      d AS (SELECT v, prefix, len(list_distinct(list_filter(string_split(substr(v, length(prefix) + 1), ''), lambda c: c <> ''))) AS distinct_chars FROM p)
      SELECT prefix, distinct_chars, regexp_full_match(v, '[0-9a-f]{40}') AND distinct_chars >= 8 AND NOT regexp_full_match(v, '0+') AS eligible, count(*) AS n FROM d GROUP BY ALL""",
    "exposure_hits": f"WITH {EXPOSED_SQL} SELECT * FROM findings",
    "exposure_by_fingerprint": f"""WITH {EXPOSED_SQL}, g AS (SELECT fingerprint, count(*) AS hits, count(DISTINCT (surface, record)) AS records, count(DISTINCT surface) AS surfaces, min((surface, record, start)) AS f FROM findings WHERE fingerprint IS NOT NULL GROUP BY fingerprint)
      SELECT fingerprint, hits, records, surfaces, dense_rank() OVER (ORDER BY f) AS ordinal FROM g""",
    "join_resolution_exact": f"WITH RECURSIVE {_JOINED} SELECT trace_id, CAST(call_idx AS BIGINT) AS call_idx, CAST(result_idx AS BIGINT) AS result_idx, confidence FROM exact",
    "join_resolution": f"WITH {_SETS} SELECT trace_id, CAST(call_idx AS BIGINT) AS call_idx, CAST(result_idx AS BIGINT) AS result_idx, confidence FROM joins",
    "gauge_report": f"""WITH RECURSIVE {_JOINED}, c AS (SELECT n.*, j.confidence FROM nodes n LEFT JOIN joins j ON j.trace_id = n.trace_id AND j.call_idx = n.idx WHERE n.kind = 'tool_call'),
      g AS (SELECT trace_id, count(*) AS calls, count(args) * 10000 // count(*) AS inspectable_bp, count(*) FILTER (degraded) * 10000 // count(*) AS degraded_bp,
        CASE WHEN count(confidence) = 0 THEN 0 ELSE count(*) FILTER (confidence = 'explicit') * 10000 // count(confidence) END AS explicit_bp,
        CASE WHEN count(confidence) = 0 THEN 0 ELSE count(*) FILTER (confidence = 'nested') * 10000 // count(confidence) END AS nested_bp,
        count(*) FILTER (args IS NOT NULL AND NOT degraded AND confidence IS NOT NULL) * 10000 // count(*) AS eligible_bp FROM c GROUP BY trace_id)
      SELECT *, CASE WHEN explicit_bp = 10000 THEN 'explicit' WHEN explicit_bp + nested_bp = 10000 THEN 'structural' ELSE 'absent' END AS linkage, inspectable_bp > 0 AS taint_capable FROM g""",
    "reachability": f"WITH RECURSIVE {REACH_SQL} SELECT trace_id, CAST(idx AS BIGINT) AS idx, CAST(lo AS BIGINT) AS lo FROM reached",
    "provenance_flows": f"WITH RECURSIVE {_FLOWS} SELECT trace_id, CAST(result_idx AS BIGINT) AS result_idx, CAST(sink_idx AS BIGINT) AS sink_idx, sink, token, origin FROM flows",
    "provenance_gauge": f"WITH RECURSIVE {_FLOWS} SELECT CASE WHEN origin IS NULL THEN 'unattributed' ELSE origin END || '->' || sink AS pair, flows, traces FROM (SELECT origin, sink, count(*) AS flows, count(DISTINCT trace_id) AS traces FROM flows GROUP BY origin, sink)",
    "verbatim_matches": f"WITH RECURSIVE {_VERBATIM} SELECT trace_id, CAST(source_idx AS BIGINT) AS source_idx, CAST(sink_idx AS BIGINT) AS sink_idx, sink, substr(sha256(value), 1, 12) AS fingerprint FROM matches",
    "flow_findings_graded": f"""WITH RECURSIVE {_FLOWS},
      labels AS (SELECT DISTINCT n.trace_id, n.idx AS source_idx, r.lo, unnest(regexp_extract_all(n.content, '{_TOKEN}')) AS value FROM nodes n JOIN reached r USING (trace_id, idx) WHERE n.kind = 'tool_result' AND n.trace_id % 2 = 0),
      matches AS (SELECT l.trace_id, l.source_idx, s.sink_idx, s.sink, l.value FROM labels l JOIN sinks s ON s.trace_id = l.trace_id AND s.sink_idx >= l.lo AND contains(replace(replace(upper(s.args), ' ', ''), '-', ''), replace(replace(upper(l.value), ' ', ''), '-', ''))),
      told AS (SELECT *, CASE sink WHEN 'send_email' THEN 'item-to-mail' ELSE 'item-to-webhook' END AS rule_id, 'verbatim' AS kind, CASE sink WHEN 'send_email' THEN 'high' ELSE 'medium' END AS severity FROM matches
        UNION ALL SELECT trace_id, result_idx, sink_idx, sink, token, 'any-to-webhook', 'provenance', 'low' FROM flows f WHERE sink = 'post_to_webhook' AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.trace_id = f.trace_id AND m.sink_idx = f.sink_idx AND m.value = f.token)),
      want AS (SELECT DISTINCT trace_id, source_idx FROM told), ends AS (SELECT trace_id, max(idx) AS last FROM nodes GROUP BY trace_id),
      edges AS (SELECT n.trace_id, n.idx AS a, n.idx + 1 AS b, 0 AS o FROM nodes n JOIN ends USING (trace_id) WHERE n.idx < last UNION ALL SELECT trace_id, call_idx, result_idx, 1 + result_idx FROM joins),
      walk(trace_id, source_idx, node, choices, path) USING KEY (trace_id, source_idx, node) AS (SELECT trace_id, source_idx, source_idx, CAST([] AS INTEGER[]), [source_idx] FROM want
        UNION SELECT w.trace_id, w.source_idx, e.b, min(list_append(w.choices, CAST(e.o AS INTEGER))), arg_min(list_append(w.path, e.b), list_append(w.choices, CAST(e.o AS INTEGER))) FROM walk w JOIN edges e ON e.trace_id = w.trace_id AND e.a = w.node
          LEFT JOIN recurring.walk r ON r.trace_id = w.trace_id AND r.source_idx = w.source_idx AND r.node = e.b WHERE r.node IS NULL GROUP BY w.trace_id, w.source_idx, e.b),
      bad AS (SELECT trace_id, list(idx) AS degraded FROM nodes WHERE degraded GROUP BY trace_id),
      graded AS (SELECT t.*, array_to_string(w.path, ',') AS path, list_has_any(w.path, coalesce(bad.degraded, [])) AS rough FROM told t JOIN walk w ON w.trace_id = t.trace_id AND w.source_idx = t.source_idx AND w.node = t.sink_idx LEFT JOIN bad ON bad.trace_id = t.trace_id),
      said AS (SELECT *, CASE WHEN rough THEN 'degraded node on witness path' ELSE '' END || CASE WHEN rough AND severity = 'medium' THEN '; ' ELSE '' END || CASE WHEN severity = 'medium' THEN 'rule stage is ''draft'', not active' ELSE '' END AS reasons FROM graded)
      SELECT trace_id, CAST(source_idx AS BIGINT) AS source_idx, CAST(sink_idx AS BIGINT) AS sink_idx, rule_id, kind, severity, path, reasons, reasons = '' AS is_verdict_grade FROM said""",
    "witness_paths": f"""WITH RECURSIVE {_VERBATIM}, want AS (SELECT DISTINCT trace_id, source_idx, sink_idx FROM matches), ends AS (SELECT trace_id, max(idx) AS last FROM nodes GROUP BY trace_id),
      edges AS (SELECT n.trace_id, n.idx AS a, n.idx + 1 AS b FROM nodes n JOIN ends USING (trace_id) WHERE n.idx < last UNION SELECT trace_id, call_idx, result_idx FROM joins),
      walk(trace_id, source_idx, node, steps) USING KEY (trace_id, source_idx, node) AS (SELECT DISTINCT trace_id, source_idx, source_idx, 0 FROM want
        UNION SELECT w.trace_id, w.source_idx, e.b, min(w.steps + 1) FROM walk w JOIN edges e ON e.trace_id = w.trace_id AND e.a = w.node
          LEFT JOIN recurring.walk r ON r.trace_id = w.trace_id AND r.source_idx = w.source_idx AND r.node = e.b WHERE r.steps IS NULL OR r.steps > w.steps + 1 GROUP BY ALL)
      SELECT want.trace_id, CAST(want.source_idx AS BIGINT) AS source_idx, CAST(want.sink_idx AS BIGINT) AS sink_idx, CAST(min(steps) AS BIGINT) AS steps FROM want JOIN walk ON walk.trace_id = want.trace_id AND walk.source_idx = want.source_idx AND walk.node = want.sink_idx GROUP BY ALL""",
    "needle_hits": f"WITH {SURFACES_SQL}, {PLACEMENTS_SQL} SELECT surface, record, placement, 'raw' AS form FROM surfaces JOIN placements ON contains(text, value) WHERE surface IN ('pages.html', 'documents.text')",
    "needle_hits_encoded": f"""WITH {SURFACES_SQL}, {PLACEMENTS_SQL}, h AS (SELECT surface, record, placement FROM surfaces JOIN placements ON contains(text, value) WHERE surface IN ('pages.html', 'documents.text'))
      SELECT surface || '.hex' AS surface, record, placement, 'hex' AS form FROM h UNION ALL SELECT surface || '.base64', record, placement, 'base64' FROM h""",
    "placement_states": f"WITH {_STATES} SELECT * FROM states",
    "judge_verdict": f"""WITH {_STATES}, {SURFACES_SQL}, a AS (SELECT count(*) FILTER (state = 'leaked') AS leaked, count(*) FILTER (state = 'unknown') AS unknown, count(*) AS placements FROM states), u AS (SELECT count(*) AS unread FROM surfaces WHERE text IS NULL)
      SELECT *, CASE WHEN leaked > 0 THEN 'leak' WHEN unread > 0 OR unknown > 0 THEN 'incomplete' ELSE 'clean' END AS verdict FROM a, u""",
    "request_parts": r"""WITH q AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS pair FROM pages)
      SELECT page_id, host, regexp_extract(pair, '^([^=]*)', 1) AS name, regexp_extract(pair, '=(.*)$', 1) AS value FROM q WHERE pair <> ''""",
    "audit_states": f"""WITH {SURFACES_SQL}, {PLACEMENTS_SQL}, h AS (SELECT placement, CASE surface WHEN 'pages.html' THEN 'tool_call' WHEN 'conversations.text' THEN 'context' ELSE 'stored' END AS kind FROM surfaces JOIN placements ON contains(text, value)
        WHERE surface IN ('pages.html', 'documents.text', 'conversations.text')),
      g AS (SELECT placement, count(*) FILTER (kind = 'tool_call') AS n_tool_call, count(*) FILTER (kind = 'context') AS n_context, count(*) FILTER (kind = 'stored') AS n_stored FROM h GROUP BY placement)
      SELECT placement AS credential, CASE WHEN n_tool_call > 0 THEN 'in_tool_call' WHEN n_context > 0 THEN 'in_context' WHEN n_stored > 0 THEN 'stored' ELSE 'not_found' END AS state,
        coalesce(n_tool_call, 0) AS n_tool_call, coalesce(n_context, 0) AS n_context, coalesce(n_stored, 0) AS n_stored FROM placements LEFT JOIN g USING (placement)""",
    "turn_numbers": "SELECT conv_id, turn, role, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS BIGINT) AS prompt_no FROM conversations",
    "session_tallies": """WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS prompt_no, regexp_extract_all(text, '[A-Z][a-z]{6,}') AS v FROM conversations)
      SELECT conv_id, count(*) AS messages, CAST(max(prompt_no) AS BIGINT) AS prompts, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(len(list_distinct(flatten(list(v)))) AS BIGINT) AS values_seen, CAST(min(prompt_no) FILTER (len(v) > 0) AS BIGINT) AS first_turn FROM t GROUP BY conv_id""",
    "span_merge_islands": f"""WITH {_SPANS}, b AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
      i AS (SELECT *, sum(CASE WHEN before IS NULL OR start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM b)
      SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS spans FROM i GROUP BY user_id, island""",
    "span_owners": f"""WITH {_SPANS}, a AS (SELECT user_id, start AS a_start, "end" AS a_end, 'click' || start AS name FROM s WHERE event_type = 'click')
      SELECT s.user_id, s.start, s."end", min_by(name, a_start) FILTER (s.start < a_end AND a_start < s."end") AS owner FROM s LEFT JOIN a USING (user_id) WHERE event_type = 'error' GROUP BY ALL""",
    "withheld_names": f"""WITH {PLACEMENTS_SQL}, n AS (SELECT DISTINCT name FROM (SELECT regexp_extract(html, 'token = &quot;([0-9a-f]{{40}})', 1) AS name FROM pages UNION ALL SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) FROM pages) WHERE name <> '' OR name IN (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) FROM pages)),
      g AS (SELECT DISTINCT substr(value, k, 6) AS g FROM placements, range(1, 36) r(k)), p AS (SELECT name, unnest(range(1, greatest(length(name) - 4, 1))) AS k FROM n),
      held AS (SELECT DISTINCT name FROM p WHERE substr(name, k, 6) IN (SELECT g FROM g))
      SELECT CASE WHEN held.name IS NOT NULL THEN '[withheld]' ELSE n.name END AS shown, count(*) AS names FROM n LEFT JOIN held USING (name) GROUP BY ALL""",
    "fact_merge": f"""WITH {FACTS_SQL} SELECT tool_name, bucket, CASE {_MODE_RANK} WHEN 2 THEN 'verbatim' ELSE 'provenance' END AS mode, count(DISTINCT role) AS n_roles,
        CASE max(CASE confidence WHEN 'explicit' THEN 4 WHEN 'nested' THEN 3 WHEN 'content_mined' THEN 2 ELSE 1 END) WHEN 4 THEN 'explicit' WHEN 3 THEN 'nested' WHEN 2 THEN 'content_mined' ELSE 'heuristic' END AS confidence,
        min_by(node_id, (CASE confidence WHEN 'explicit' THEN -4 WHEN 'nested' THEN -3 WHEN 'content_mined' THEN -2 ELSE -1 END, node_id)) AS witness_first, count(*) AS observations FROM facts GROUP BY ALL""",
    "required_allowed": f"""WITH {FACTS_SQL}, f AS (SELECT * FROM facts WHERE bucket < 11 OR run < 2)
      SELECT tool_name, bucket, CAST({_MODE_RANK} AS BIGINT) AS mode_rank, count(DISTINCT run) = (SELECT count(DISTINCT run) FROM f) AS required FROM f GROUP BY ALL""",
    "baseline_delta": f"""WITH {FACTS_SQL}, f AS (SELECT * FROM facts WHERE run < 4 AND NOT (tool_name = 'send_email' AND bucket = 3) AND (mode = 'provenance' OR bucket > 2)),
      b AS (SELECT tool_name, bucket, {_MODE_RANK} AS mode_rank, count(DISTINCT run) = (SELECT count(DISTINCT run) FROM f) AS required FROM f GROUP BY ALL),
      c AS (SELECT tool_name, bucket, {_MODE_RANK} AS new_rank FROM facts WHERE run = 4 AND bucket <> 7 GROUP BY ALL),
      d AS (SELECT tool_name, bucket, CASE WHEN mode_rank IS NULL THEN 'new_fact_unguarded' WHEN new_rank IS NULL AND required THEN 'required_fact_missing' WHEN new_rank > mode_rank THEN 'mode_escalation' END AS kind FROM b FULL JOIN c USING (tool_name, bucket))
      SELECT *, CASE kind WHEN 'required_fact_missing' THEN 'warn' ELSE 'fail' END AS severity FROM d WHERE kind IS NOT NULL""",
    "name_suggests_secret": """WITH w AS (SELECT unnest(['client', 'api', 'public', 'token', 'key', 'user', 'password', 'n', 'ssh', 'keys']) AS w)
      SELECT upper(a.w) || '_' || upper(b.w) AS name, a.w IN ('token', 'password') OR b.w IN ('token', 'password') OR (b.w IN ('key', 'keys') AND a.w <> 'public') AS secret FROM w a JOIN w b ON a.w <> b.w""",
}
