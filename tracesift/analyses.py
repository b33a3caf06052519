"""More of the analyser's queries over the driver tables: rules, views, requests, audits, inventories, sessions, baselines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracesift.catalog import Rule
from tracesift.functions.arguments import destinations, leaves
from tracesift.lineage import kept
from tracesift.operators import audit, evaluate, facts, guard, inventory, judge, requests, session_report, taint
from tracesift.queries import EXPOSED_SQL, FACTS_SQL, IDENTITY, KEY, REACH_SQL, capture, event_facts, event_trace, simple_findings
from tracesift.sources import ignore, locations, trajectories
from tracesift.sources import sessions as records
from tracesift.sources.driver_tables import PLACEMENTS_SQL, SURFACES_SQL, placements, table
from tracesift.streaming import markers

_HOME, _NOW = "/home/u", 2_000_000_000.0


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def context_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each node taints: a stretch to the end of its trace."""
    return _long(taint.context(*event_trace(spark, sf_dir)), "idx", "lo", "last_idx")


def sink_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of calls as JSON with the destination inside, found in the sinks' key order; and how many strings they hold."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    tool = F.when(F.col("event_type") == "click", "send_email").when(F.col("event_type") == "signup", "post_to_webhook").otherwise("read_file")
    args = F.concat(F.lit('{"meta": [{"n": 1, "deep": {"to": "user'), F.col("user_id").cast("string"), F.lit('", "url": "http://h/'), F.col("k"), F.lit('"}}], "url": 5, "list": [["no"]]}'))
    rows = e.withColumns({"tool": tool, "args": args})
    return rows.select("event_id", "tool", destinations(F.col("args"), F.col("tool"), {"send_email": ("to",), "post_to_webhook": ("url", "to")}).alias("destination"), F.size(leaves(F.col("args"))).cast("long").alias("strings"))


_EXPOSURE_RULES = (Rule("hex-in-telemetry", "exposure", "hex_service_token", None), Rule("hex-draft", "exposure", "hex_service_token", None, "low", stage="draft"), Rule("field-in-telemetry", "exposure", "credential_field", None, "medium"))


def exposure_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by rule: two rules for one class, one of them a draft, and a class without a floor."""
    rows = evaluate.exposure_findings(spark, simple_findings(spark, sf_dir), _EXPOSURE_RULES)
    return _long(rows.select("surface", "record", "class", "start", "rule_id", "severity", F.array_join("reasons", "; ").alias("reasons"), "is_verdict_grade"), "start")


def exposure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(simple_findings(spark, sf_dir))


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements whose value needs escaping: the assignment that documents hold."""
    return placements(spark, sf_dir).select("placement", F.concat(F.lit('token = "'), F.col("value"), F.lit('"')).alias("value"))


def decoded_view_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as strings in JSON, escaped once to four times: spellings find two of them, views the rest."""
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("record"), "text")
    out = None
    for k in range(5):
        part = rows.select(F.lit(f"escaped {k}").alias("surface"), "record", "text")
        out = part if out is None else out.unionByName(part)
        rows = rows.withColumn("text", F.expr("to_json(array(text))"))
    return judge.find_viewed(spark, out, judge.needle_table(_quoted(spark, sf_dir)))[0]


def request_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captured requests: a header that may be a credential field, a query, and the page as body; who got which value, and was it its own provider."""
    p = table(spark, sf_dir, "pages")
    token = F.regexp_extract("html", "([0-9a-f]{40})", 1)
    served = F.col("page_id") % 3 != 0
    captured = p.select(
        F.col("page_id").alias("request"), F.when(served, "served").otherwise("refused").alias("outcome"), F.when(served, F.concat(F.lit("e"), (F.col("page_id") % 2).cast("string"))).alias("endpoint"),
        F.when(F.col("page_id") % 2 == 0, "OWN.example").otherwise("other.example").alias("host"), F.lit(443).alias("port"), F.lit("POST").alias("method"), F.lit(None).cast("string").alias("path"),
        F.concat(F.lit("q="), token).alias("query"), F.array(F.array(F.lit("Authorization"), F.concat(F.lit("Bearer "), token))).alias("headers"), F.regexp_replace(F.base64(F.coalesce("html", F.lit("")).cast("binary")), "\r\n", "").alias("body"),
        F.lit(None).cast("string").alias("unread"), F.when(F.col("page_id") % 5 != 0, F.array(F.array(F.lit("header"), F.lit("AUTHORIZATION")))).alias("credential_fields"), F.lit(None).cast("string").alias("fault"),
    )
    placed = placements(spark, sf_dir).withColumns({"providers": F.array(F.lit("e0")), "provider_host": F.lit("own.example")})
    return requests.judged(spark, captured, placed, judge.needle_table(placed))["attributed"].select("request", "placement", "location", "form", "credential", "own", "sink")


def capture_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as a capture of which a part could not be read: no hit on what is left is no all-clear."""
    p = placements(spark, sf_dir).withColumns({"kind": F.lit("env"), "required": F.col("placement") > "8"})
    whole = capture(spark, sf_dir)
    read = whole.filter("text IS NOT NULL AND NOT (surface = 'documents.text' AND record % 7 = 3)")
    hits, _ = judge.find_viewed(spark, read, judge.needle_table(p))
    unread = whole.join(read.select("surface", "record").distinct(), ["surface", "record"], "left_anti").select(F.lit("not_scanned").alias("reason"), F.concat_ws(":", "surface", "record").alias("subject"))
    states = judge.placement_states(p, hits, p.filter("placement < 'c'").select("placement", F.lit("request").alias("evidence")))
    why = unread.unionByName(states.filter("required AND state = 'not_exercised'").select(F.lit("required_not_exercised").alias("reason"), F.col("placement").alias("subject"))).distinct()
    return judge.decided(states, why).withColumns({"reasons": F.array_join("reasons", ","), "exit_code": F.col("exit_code").cast("long")})


def audit_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose stored value stands in one of five spellings instead: the audit finds each by its decodings."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    value, bare = F.regexp_extract("text", 'token = "([0-9a-f]{40})"', 1), F.regexp_replace("text", '"[0-9a-f]{40}"', "")
    inside = F.concat(F.lit("zz "), value, F.lit(" yy")).cast("binary")
    form = F.element_at(F.array(F.lit("path"), F.lit("json"), F.lit("url"), F.lit("base64"), F.lit("hex")), F.pmod("doc_id", F.lit(5)).cast("int") + 1)
    spelled = (
        F.when(form == "path", F.concat(F.lit(" https://h/?t="), value, F.lit("&u=1"))).when(form == "json", F.concat(F.lit(' "a\\u0020'), value, F.lit('\\n"')))
        .when(form == "url", F.concat(F.lit(" q=%"), F.hex(F.substring(value, 1, 1)), F.expr("substring(regexp_extract(text, 'token = \"([0-9a-f]{40})\"', 1), 2)"))).when(form == "base64", F.concat(F.lit(" b:"), F.base64(inside))).otherwise(F.concat(F.lit(" 0x"), F.hex(inside)))
    )
    places = d.select(F.col("doc_id").alias("record"), form.alias("kind"), F.when(value != "", F.concat(bare, spelled)).otherwise(F.col("text")).alias("text"))
    stored = audit.fingerprints(placements(spark, sf_dir).withColumnRenamed("placement", "credential"), KEY)
    return audit.hits(spark, places, stored, KEY).groupBy("kind", "credential", "form").agg(F.countDistinct("record").alias("records"))


def guard_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands made of events, held against the guard."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    n = F.col("event_id") % 8
    command = F.when(n == 0, "env").when(n == 1, F.concat(F.lit('echo "$V'), "k", F.lit('" | cat'))).when(n == 2, F.concat(F.lit("cat ~/f"), "k")).when(n == 3, "x=$(sudo -u me gh auth token)")
    command = command.when(n == 4, F.concat(F.lit("echo '$V"), "k", F.lit("'"))).when(n == 5, F.concat(F.lit("sh -c 'head < /home/u/f"), "k", F.lit("'"))).when(n == 6, "aws configure get region").otherwise(F.concat(F.lit("echo $V"), "k", F.lit(" > /tmp/x")))
    rows = e.withColumn("rule", guard.forbidden(command, ["V1", "V3", "V5"], [f"{_HOME}/f2", f"{_HOME}/f4"], _HOME, _HOME))
    return rows.groupBy((F.col("event_id") % 8).alias("kind"), "rule").agg(F.count(F.lit(1)).alias("n"))


def trajectory_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as message lists, read back as trace nodes."""
    c = table(spark, sf_dir, "conversations").withColumn("m", F.struct("role", F.col("text").alias("content")))
    runs = c.groupBy(F.col("conv_id").cast("string").alias("trace")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "m"))), lambda x: x["m"])).alias("messages"))
    found = trajectories.nodes(runs)
    return _long(found.groupBy("trace", "kind").agg(F.count(F.lit(1)).alias("nodes"), F.min("idx").alias("first"), F.sum(F.length("content")).alias("chars")), "first", "chars")


def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of events under layered ignore rules: the last rule decides, a folder's rule goes before its files'."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    paths = e.select(F.concat_ws("/", F.concat(F.lit("u"), F.col("user_id").cast("string")), "event_type", F.concat(F.lit("f"), F.col("k").cast("string"), F.when(F.col("k") % 2 == 0, ".log").otherwise(".txt"))).alias("path")).distinct()
    ruled = ignore.rules(spark, [("", "*.log\n!f4.log\n/u1/**\nerror/\n"), ("u2", "view/f?.txt\n")])
    rows = ignore.ignored(paths, ruled)
    return rows.select("path", "ignored")


def inventory_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings files made of customers, judged field by field; equal values are linked."""
    # the rows are few bytes and much work, so they are dealt out to all cores, not by the bytes of their files
    c = table(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey").select("c_custkey", F.sha1(F.concat(F.lit("v"), (F.col("c_custkey") % 40).cast("string")).cast("binary")).alias("v"))
    text = F.concat(F.lit("[p"), F.col("c_custkey").cast("string"), F.lit("]\naws_access_key_id = id"), F.col("c_custkey").cast("string"), F.lit("\nregion = eu-west-1\napi_token = "), F.col("v"), F.lit("\nname = plain\nretries = 3\n"))
    files = c.select(F.concat(F.lit(f"file:{_HOME}/.aws/credentials")).alias("path"), text.cast("binary").alias("content"))
    found = kept(inventory.of_locations(locations.fields(locations.located(files, _HOME, {}))))
    fps = found.select("value").distinct().withColumn("fp", F.sha2("value", 256))
    rows = inventory.identified(found, fps)
    return rows.groupBy("source", "name", "reason").agg(F.count(F.lit(1)).alias("credentials"), F.countDistinct("id").alias("ids"), F.countDistinct("fp").alias("values_seen"), F.sum("n_same").alias("linked"))


def project_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as project files: assignments to secret-sounding names and known shapes, overlapping finds as one."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    rows = inventory.merged(inventory.detected(d))
    return rows.filter("value rlike '^[0-9a-f]{40}$'").select("path", "name", "reason", F.substring(F.sha2("value", 256), 1, 12).alias("fingerprint"), F.size("places").cast("long").alias("places"))


def _session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    content = F.to_json(F.struct(F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("type"), F.lit("s").alias("sessionId"), F.struct("role", F.col("text").alias("content")).alias("message")))
    line = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role")).cast("long")
    return c.select(F.concat(F.lit("/s/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"), line.alias("line"), content.cast("binary").alias("data"))


def session_first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as session files: where long capitalised words first reached the agent, by turn."""
    numbered = _session_lines(spark, sf_dir)
    sites = records.sites(numbered).filter("unread IS NULL AND place <> 'stored'")
    hits = sites.select("file", "line", F.col("place").alias("kind"), "tool", "argument", "record_type", "path", "is_error", F.lit("session").alias("format"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{8,}"), 0))).alias("credential"))
    turned = records.hit_turns(hits, records.facts(numbered), spark.createDataFrame([], "file string, tool_use string"))
    found = session_report.firsts(turned)
    return _long(found.select("credential", "kind", "turn", "file", "line", "how", "hits"), "turn", "line")


def redaction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as redaction markers: the last state of each call, late ones failed."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    state = F.when(F.col("event_type").isin("view", "purchase"), "done").when(F.col("event_type") == "error", "failed").otherwise("pending")
    rows = e.select(F.col("user_id").cast("string").alias("session"), "k", state.alias("state"), (F.lit(_NOW) - F.col("event_id") % 40).alias("at"), F.expr("cast(map() AS map<string, bigint>)").alias("kept_out")).withColumnRenamed("k", "call")
    return markers.settled(rows, _NOW).groupBy("outcome").agg(F.count(F.lit(1)).alias("calls"))


def baseline_guarded_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of difference between runs, with guards."""
    f = event_facts(spark, sf_dir).withColumn("g", F.when(F.col("bucket") % 4 == 0, F.concat(F.lit("g"), (F.col("bucket") % 3).cast("string"))))
    base = facts.baseline(f.filter("run < 4 AND bucket < 10 AND (mode = 'provenance' OR bucket > 2)"), IDENTITY).withColumn("guard", F.when(F.col("bucket") % 4 == 0, F.concat(F.lit("g"), (F.col("bucket") % 3).cast("string"))))
    candidate = f.filter("run = 4 AND bucket <> 7 AND (mode = 'provenance' OR bucket <> 5)").withColumn("guard", F.when(F.col("bucket") == 4, None).when(F.col("bucket") == 8, "other").otherwise(F.col("g")))
    return facts.guarded(base, candidate, IDENTITY, ["send_email", "read_file"], worse=("new_uncataloged_tool",))


def baseline_unsound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of a baseline made of five runs, some of them broken on purpose."""
    f = event_facts(spark, sf_dir)
    allowed = f.groupBy(*IDENTITY).agg(F.max("mode").alias("mode"))
    counts = f.filter("bucket <> 2").groupBy(*IDENTITY).agg((F.countDistinct("run") + F.when(F.col("bucket") == 3, 9).otherwise(0)).alias("n"))
    required = allowed.filter("bucket < 6").withColumn("mode", F.when(F.col("bucket") == 5, "none").otherwise(F.col("mode")))
    accepted = allowed.filter("bucket = 1").select(*IDENTITY)
    return facts.unsound(allowed, required, accepted, counts, 5, IDENTITY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        context_taint, sink_destinations, exposure_findings, exposure_summary, decoded_view_hits, request_attribution, capture_verdict, audit_forms, guard_rules, trajectory_nodes, ignored_paths,
        inventory_fields, project_credentials, session_first_hits, redaction_outcomes, baseline_guarded_delta, baseline_unsound,
    )
}

_E = "e AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k FROM events)"
_HELD = f"{PLACEMENTS_SQL}, held AS (SELECT doc_id AS record, placement, value, text FROM documents JOIN placements ON contains(text, 'token = \"' || value || '\"'))"

ORACLE_SQL: dict[str, str] = {
    "context_taint": f"WITH RECURSIVE {REACH_SQL}, ends AS (SELECT trace_id, max(idx) AS last_idx FROM nodes GROUP BY trace_id) SELECT trace_id, CAST(idx AS BIGINT) AS idx, CAST(lo AS BIGINT) AS lo, CAST(last_idx AS BIGINT) AS last_idx FROM reached JOIN ends USING (trace_id) WHERE lo <= last_idx",
    "sink_destinations": f"""WITH {_E} SELECT event_id, CASE event_type WHEN 'click' THEN 'send_email' WHEN 'signup' THEN 'post_to_webhook' ELSE 'read_file' END AS tool,
      CASE event_type WHEN 'click' THEN 'user' || user_id WHEN 'signup' THEN 'http://h/' || k END AS destination, CAST(3 AS BIGINT) AS strings FROM e""",
    "exposure_findings": f"""WITH {EXPOSED_SQL}, r AS (SELECT * FROM (VALUES ('hex-in-telemetry', 'hex_service_token', 'high', 'active'), ('hex-draft', 'hex_service_token', 'low', 'draft'), ('field-in-telemetry', 'credential_field', 'medium', 'active')) t(rule_id, class, severity, stage))
      SELECT surface, record, class, start, rule_id, severity, CASE WHEN NOT is_verdict_grade THEN 'value shape not eligible for ' || class WHEN stage = 'draft' THEN 'rule ' || rule_id || ' is in stage ''draft'', not active' ELSE '' END AS reasons,
        is_verdict_grade AND stage = 'active' AS is_verdict_grade FROM findings JOIN r USING (class)""",
    "exposure_summary": f"""WITH {EXPOSED_SQL} SELECT CASE WHEN is_verdict_grade THEN 'credential' ELSE 'review' END AS grade, count(*) AS hits, count(DISTINCT fingerprint) AS values_seen, count(DISTINCT surface) AS places, count(DISTINCT (surface, record)) AS records,
      string_agg(DISTINCT class, ', ' ORDER BY class) AS classes FROM findings GROUP BY 1""",
    "decoded_view_hits": f"WITH {_HELD} SELECT 'escaped ' || k AS surface, record, placement, CASE k WHEN 0 THEN 'raw' WHEN 1 THEN 'json' ELSE 'json2' END AS form FROM (SELECT DISTINCT record, placement FROM held), range(0, 5) r(k)",
    "request_attribution": f"""WITH {PLACEMENTS_SQL}, t AS (SELECT page_id, html, regexp_extract(html, '([0-9a-f]{{40}})', 1) AS token FROM pages),
      f AS (SELECT page_id, placement, unnest(['headers.authorization', 'query.q']) AS location FROM t JOIN placements ON token = value UNION ALL SELECT page_id, placement, 'body' FROM t JOIN placements ON contains(html, value))
      SELECT page_id AS request, placement, location, 'raw' AS form, location = 'headers.authorization' AND page_id % 5 <> 0 AS credential, page_id % 2 = 0 AS own,
        CASE WHEN page_id % 3 <> 0 THEN 'e' || page_id % 2 WHEN page_id % 2 = 0 THEN 'own.example (blocked)' ELSE 'other.example (blocked)' END AS sink FROM f""",
    "capture_verdict": f"""WITH {SURFACES_SQL}, {PLACEMENTS_SQL}, c AS (SELECT * FROM surfaces WHERE surface IN ('pages.html', 'documents.text')), r AS (SELECT * FROM c WHERE text IS NOT NULL AND NOT (surface = 'documents.text' AND record % 7 = 3)),
      l AS (SELECT DISTINCT placement FROM r JOIN placements ON contains(text, value)), s AS (SELECT placement, placement > '8' AS required, CASE WHEN placement IN (SELECT placement FROM l) THEN 'leaked' WHEN placement < 'c' THEN 'exercised' ELSE 'not_exercised' END AS state FROM placements),
      w AS (SELECT DISTINCT 'not_scanned' AS reason, surface || ':' || record AS subject FROM c WHERE (surface, record) NOT IN (SELECT surface, record FROM r) UNION SELECT 'required_not_exercised', placement FROM s WHERE required AND state = 'not_exercised'),
      a AS (SELECT count(*) AS placements, count(*) FILTER (state = 'leaked') AS leaked, count(*) FILTER (state = 'exercised') AS exercised, count(*) FILTER (state = 'not_exercised') AS not_exercised FROM s),
      u AS (SELECT count(*) AS unread, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM w)
      SELECT *, CASE WHEN leaked > 0 THEN 'leak' WHEN unread > 0 THEN 'incomplete' ELSE 'clean' END AS verdict, CAST(CASE WHEN leaked > 0 THEN 1 WHEN unread > 0 THEN 3 ELSE 0 END AS BIGINT) AS exit_code FROM a, u""",
    "audit_forms": f"""WITH {PLACEMENTS_SQL}, t AS (SELECT doc_id, ['path', 'json', 'url', 'base64', 'hex'][doc_id % 5 + 1] AS kind, regexp_extract(text, 'token = "([0-9a-f]{{40}})"', 1) AS value FROM documents)
      SELECT kind, placement AS credential, CASE kind WHEN 'path' THEN 'raw' ELSE kind END AS form, count(*) AS records FROM t JOIN placements USING (value) GROUP BY ALL""",
    "guard_rules": f"""WITH {_E}, r AS (SELECT event_id % 8 AS kind, CASE event_id % 8 WHEN 0 THEN 'env-dump' WHEN 1 THEN CASE WHEN k IN ('1', '3', '5') THEN 'credential-variable' END WHEN 2 THEN CASE WHEN k IN ('2', '4') THEN 'credential-file' END
        WHEN 3 THEN 'gh-auth-token' WHEN 5 THEN CASE WHEN k IN ('2', '4') THEN 'credential-file' END END AS rule FROM e) SELECT kind, rule, count(*) AS n FROM r GROUP BY ALL""",
    "trajectory_nodes": """WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS idx, CASE role WHEN 'assistant' THEN 'llm_call' ELSE 'user_input' END AS kind, text FROM conversations)
      SELECT CAST(conv_id AS VARCHAR) AS trace, kind, count(*) AS nodes, CAST(min(idx) AS BIGINT) AS first, CAST(sum(length(text)) AS BIGINT) AS chars FROM o GROUP BY ALL""",
    "ignored_paths": f"""WITH {_E}, p AS (SELECT DISTINCT user_id, event_type, CAST(k AS INTEGER) AS k, 'u' || user_id || '/' || event_type || '/f' || k || CASE WHEN CAST(k AS INTEGER) % 2 = 0 THEN '.log' ELSE '.txt' END AS path FROM e)
      SELECT path, event_type = 'error' OR user_id = 1 OR (k % 2 = 0 AND k <> 4) OR (user_id = 2 AND event_type = 'view' AND k % 2 = 1 AND k < 10) AS ignored FROM p""",
    "inventory_fields": """WITH c AS (SELECT c_custkey, c_custkey % 40 AS v FROM customer), g AS (SELECT v, count(*) AS n FROM c GROUP BY v)
      SELECT 'location:aws_credentials' AS source, 'aws_access_key_id' AS name, 'location' AS reason, count(*) AS credentials, count(*) AS ids, count(*) AS values_seen, CAST(0 AS BIGINT) AS linked FROM c
      UNION ALL SELECT 'location:aws_credentials', 'api_token', 'name', (SELECT count(*) FROM c), (SELECT count(*) FROM c), count(*), CAST(sum(n * (n - 1)) AS BIGINT) FROM g""",
    "project_credentials": """WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, 'token = "([0-9a-f]{40})"', 1)) AS v FROM documents WHERE text IS NOT NULL)
      SELECT 'doc' || doc_id || '.md' AS path, 'token' AS name, 'name' AS reason, substr(sha256(v), 1, 12) AS fingerprint, count(*) AS places FROM m GROUP BY doc_id, v""",
    "session_first_hits": r"""WITH l AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS line, sum(CASE WHEN role = 'assistant' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS turn FROM conversations),
      h AS (SELECT DISTINCT '/s/' || conv_id || '.jsonl' AS file, line, turn, role, unnest(regexp_extract_all(text, '\b[A-Z][a-z]{8,}')) AS credential FROM l),
      n AS (SELECT *, row_number() OVER (PARTITION BY credential ORDER BY turn, file, line) AS k, count(*) OVER (PARTITION BY credential) AS hits FROM h)
      SELECT credential, 'context' AS kind, CAST(turn AS BIGINT) AS turn, file, CAST(line AS BIGINT) AS line, CASE role WHEN 'assistant' THEN 'model''s own text' ELSE 'prompt' END AS how, hits FROM n WHERE k = 1""",
    "redaction_outcomes": f"""WITH {_E}, m AS (SELECT user_id, k, CASE WHEN event_type IN ('view', 'purchase') THEN 'done' WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END AS state, event_id % 40 AS age FROM e),
      s AS (SELECT user_id, k, arg_max(state, (-age, state)) AS state, min(age) AS age FROM m GROUP BY user_id, k) SELECT CASE WHEN state = 'done' THEN 'done' WHEN state = 'pending' AND age <= 10 THEN 'pending' ELSE 'failed' END AS outcome, count(*) AS calls FROM s GROUP BY 1""",
    "baseline_guarded_delta": f"""WITH {FACTS_SQL}, g AS (SELECT *, CASE WHEN bucket % 4 = 0 THEN 'g' || bucket % 3 END AS g FROM facts), bf AS (SELECT * FROM g WHERE run < 4 AND bucket < 10 AND (mode = 'provenance' OR bucket > 2)),
      b AS (SELECT tool_name, bucket, max(g) AS guard, max(CASE mode WHEN 'verbatim' THEN 2 ELSE 1 END) AS r, count(DISTINCT run) = (SELECT count(DISTINCT run) FROM bf) AS required, true AS old FROM bf GROUP BY tool_name, bucket),
      cf AS (SELECT *, CASE WHEN bucket = 4 THEN NULL WHEN bucket = 8 THEN 'other' ELSE g END AS guard FROM g WHERE run = 4 AND bucket <> 7 AND (mode = 'provenance' OR bucket <> 5)),
      c AS (SELECT tool_name, bucket, max(guard) AS ng, max(CASE mode WHEN 'verbatim' THEN 2 ELSE 1 END) AS nr, true AS new FROM cf GROUP BY tool_name, bucket),
      d AS (SELECT tool_name, bucket, CASE WHEN old IS NULL THEN CASE WHEN ng IS NULL THEN 'new_fact_unguarded' ELSE 'new_fact_guarded' END WHEN new IS NULL THEN CASE WHEN required THEN 'required_fact_missing' ELSE 'allowed_fact_missing' END
        WHEN guard IS NOT NULL AND ng IS NULL THEN 'guard_removed' WHEN guard <> ng THEN 'guard_swap' WHEN nr > r THEN 'mode_escalation' WHEN nr < r THEN 'mode_deescalation' END AS kind FROM b FULL JOIN c USING (tool_name, bucket)
        UNION ALL SELECT DISTINCT tool_name, bucket, 'new_uncataloged_tool' FROM cf WHERE tool_name NOT IN ('send_email', 'read_file'))
      SELECT tool_name, bucket, kind, CASE WHEN kind IN ('new_fact_guarded', 'required_fact_missing') THEN 'warn' WHEN kind IN ('mode_deescalation', 'allowed_fact_missing') THEN 'info' ELSE 'fail' END AS severity,
        CASE kind WHEN 'new_uncataloged_tool' THEN 'evidentiary' ELSE 'behavioral' END AS attribution FROM d WHERE kind IS NOT NULL""",
    "baseline_unsound": f"""WITH {FACTS_SQL}, a AS (SELECT tool_name, bucket, max(mode) AS mode FROM facts GROUP BY tool_name, bucket), n AS (SELECT tool_name, bucket, count(DISTINCT run) + CASE WHEN bucket = 3 THEN 9 ELSE 0 END AS n FROM facts WHERE bucket <> 2 GROUP BY tool_name, bucket),
      q AS (SELECT tool_name, bucket, CASE WHEN bucket = 5 THEN 'none' ELSE mode END AS mode FROM a WHERE bucket < 6)
      SELECT tool_name, bucket, 'count_missing' AS reason FROM a WHERE bucket = 2 UNION ALL SELECT tool_name, bucket, 'count_of_nothing' FROM a WHERE bucket = 1 UNION ALL SELECT tool_name, bucket, 'count_out_of_range' FROM n WHERE n > 5
      UNION ALL SELECT tool_name, bucket, 'required_not_allowed' FROM q WHERE bucket = 5
      UNION ALL SELECT q.tool_name, q.bucket, 'required_not_in_all_runs' FROM q LEFT JOIN n USING (tool_name, bucket) WHERE q.bucket <> 1 AND coalesce(n.n, 0) <> 5""",
}
