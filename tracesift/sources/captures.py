"""Ledgers, captured requests and scanner reports: strict records, and what is wrong with them as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: record types of a ledger with their members.
LEDGER = {
    "placement": ("id", "kind", "value", "required", "providers"),
    "exercised": ("placement", "evidence"),
    "flow": ("id", "status"),
    "unexpected": ("id",),
    "network": ("isolated", "required"),
    "direct": ("flow", "protocol", "target", "attempts"),
}
OPTIONAL = {"placement": ("provider_host",)}
STATUSES, EVIDENCE = ("ok", "failed", "timeout", "skipped"), ("request", "minted", "egress")
REQUEST = ("outcome", "endpoint", "host", "port", "method", "path", "query", "headers", "body", "unread", "credential_fields")


def records(spark: SparkSession, path: str) -> DataFrame:
    """file line -> type and the record as variant; a duplicate key or no JSON gives a null record."""
    rows = spark.read.text(path).withColumn("record", F.try_parse_json("value")).withColumn("keys", F.json_object_keys("value"))
    return rows.select("value", "record", "keys", F.try_variant_get("record", "$.type", "string").alias("type"))


def placements(ledger: DataFrame) -> DataFrame:
    g = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind).alias(name)
    return ledger.filter("type = 'placement'").select(g("id", "string").alias("placement"), g("kind", "string"), g("value", "string"), g("required", "boolean"), F.try_variant_get("record", "$.providers", "array<string>").alias("providers"), g("provider_host", "string"))


def exercised(ledger: DataFrame) -> DataFrame:
    return ledger.filter("type = 'exercised'").select(F.try_variant_get("record", "$.placement", "string").alias("placement"), F.try_variant_get("record", "$.evidence", "string").alias("evidence"))


def violations(ledger: DataFrame) -> DataFrame:
    """subject, reason: unreadable lines, unknown types and members, missing ones, repeated and dangling ids, short values."""
    named = ledger.filter("type IS NOT NULL")
    allowed = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k, v in LEDGER.items() for x in (k, ("type", *v, *OPTIONAL.get(k, ())))])
    needed = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k, v in LEDGER.items() for x in (k, v)])
    p, e = placements(ledger), exercised(ledger)
    parts = [
        ledger.filter("record IS NULL").select(F.lit("?").alias("subject"), F.lit("not_json").alias("reason")),
        named.filter(~F.col("type").isin(*LEDGER)).select(F.col("type"), F.lit("unknown_type")),
        named.filter(F.size(F.array_except("keys", F.coalesce(allowed[F.col("type")], F.col("keys")))) > 0).select(F.col("type"), F.lit("unknown_member")),
        named.filter(F.size(F.array_except(F.coalesce(needed[F.col("type")], F.array()), "keys")) > 0).select(F.col("type"), F.lit("missing_member")),
        p.groupBy("placement").count().filter("count > 1").select("placement", F.lit("repeated_id")),
        p.filter(F.length("value") < 16).select("placement", F.lit("short_value")),
        e.join(p, "placement", "left_anti").select("placement", F.lit("dangling_placement")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Captured requests: every member but the optional ones is there, and a body is strict base64."""
    schema = "outcome string, endpoint string, host string, port int, method string, path string, query string, headers array<array<string>>, body string, unread string, credential_fields array<array<string>>"
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("request"), F.from_json("value", schema).alias("r"), F.json_object_keys("value").alias("keys"))
    strict = F.col("r.body").isNull() | F.col("r.body").rlike(r"\A(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    fault = F.when(F.col("r").isNull() | F.col("keys").isNull(), "not_json").when(F.size(F.array_except("keys", F.array(*map(F.lit, REQUEST)))) > 0, "unknown_member").when(F.col("r.outcome").isNull() | F.col("r.host").isNull() | F.col("r.headers").isNull(), "missing_member").when(~strict, "bad_body")
    return rows.select("request", "r.*", fault.alias("fault"))


def request_parts(captured: DataFrame) -> DataFrame:
    """request, location, name, data: path, query members, headers and body, each a place a value can be in."""
    sound = captured.filter("fault IS NULL")
    whole = lambda location, column: sound.filter(F.col(column).isNotNull()).select("request", F.lit(location).alias("location"), F.lit("").alias("name"), F.col(column).cast("binary").alias("data"))
    query = sound.filter("query <> ''").select("request", F.explode(F.split("query", "&")).alias("m")).select("request", F.lit("query").alias("location"), F.substring_index("m", "=", 1).alias("name"), F.expr("substring(m, length(substring_index(m, '=', 1)) + 2)").cast("binary").alias("data"))
    headers = sound.select("request", F.explode("headers").alias("h")).select("request", F.lit("header").alias("location"), F.lower(F.get("h", 0)).alias("name"), F.get("h", 1).cast("binary").alias("data"))
    body = sound.filter("body IS NOT NULL").select("request", F.lit("body").alias("location"), F.lit("").alias("name"), F.unbase64("body").alias("data"))
    return whole("path", "path").unionByName(query).unionByName(headers).unionByName(body)


def own_provider(parts: DataFrame, captured: DataFrame, hits: DataFrame, placed: DataFrame) -> DataFrame:
    """Hits with `own`: the request went to a provider of the placement, by endpoint if served, else by host."""
    r = captured.select("request", "outcome", "endpoint", F.lower("host").alias("host"))
    p = placed.select("placement", "providers", F.lower("provider_host").alias("provider_host"))
    own = F.when(F.col("outcome") == "served", F.array_contains("providers", F.col("endpoint"))).otherwise(F.col("host") == F.col("provider_host"))
    return hits.join(r, "request").join(p, "placement").withColumn("own", F.coalesce(own, F.lit(False)))


def gitleaks(spark: SparkSession, path: str) -> DataFrame:
    """scanner, rule, file, line, value: a redacted value is null."""
    rows = spark.read.schema("RuleID string, File string, StartLine int, Secret string").option("multiLine", True).json(path)
    value = F.when((F.col("Secret") != "") & (F.upper("Secret") != "REDACTED"), F.col("Secret"))
    return rows.select(F.lit("gitleaks").alias("scanner"), F.col("RuleID").alias("rule"), F.col("File").alias("file"), F.col("StartLine").alias("line"), value.alias("value"))


def trufflehog(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")
    g = lambda p, kind: F.try_variant_get("v", p, kind)
    return rows.select(F.lit("trufflehog").alias("scanner"), g("$.DetectorName", "string").alias("rule"), g("$.SourceMetadata.Data.Filesystem.file", "string").alias("file"), g("$.SourceMetadata.Data.Filesystem.line", "int").alias("line"), g("$.Raw", "string").alias("value"))
