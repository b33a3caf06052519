"""Which credentials a machine and a project hold: judged fields, detected values, and one record for each.

Fields of standard files are judged by name, shape and whether their format names them; project texts are searched by
class, by assignment to a secret-sounding name, and by standalone shapes. Overlapping finds are one credential.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracesift.catalog import CLASSES
from tracesift.functions.eligibility import assignment_prefix, eligible, full
from tracesift.functions.hashing import credential_id
from tracesift.functions.names import name_words, not_secret_kind, suggests_secret, value_shape
from tracesift.operators import exposure
from tracesift.sources.locations import LOCATIONS

#: Formats that hold nothing but credentials: whatever their reader finds is one.
SOLE = ("netrc", "git_credentials", "pgpass", "token_file", "private_key")
#: Letters that a value assigned to a secret-sounding name has at least.
SHORTEST = 8
#: Endings of program texts, folders that are not searched, folders of others' code that are only named.
CODE = (".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".java", ".rb", ".rs", ".c", ".cc", ".cpp", ".h", ".cs", ".php", ".swift", ".kt", ".scala", ".sh")
SKIPPED, VENDORED = (".git",), ("node_modules", "vendor", ".venv", "venv", "site-packages")
#: What is written where a secret would stand.
_PLACEHOLDER = r"(?:\$\{?[A-Za-z_][A-Za-z0-9_]*\}?.*|\{\{.*\}\}|<[^>]*>|%\(.*\)s|%[sd]|[*xX#.\-_]+|(?i:none|null|nil|undefined|redacted|changeme|example|placeholder|true|false))"
_EXPRESSION = r"[A-Za-z_$][\w$]*(?:\s*(?:\.|::|->)\s*[A-Za-z_$][\w$]*)*"
_REFERENCE = r"\$\{[A-Za-z_][A-Za-z0-9_]*\}"


def field_reason(name: Column, value: Column, location: Column) -> Column:
    """Why a field of a standard file is a credential (location, shape, name), or null."""
    of = lambda items: F.array(*map(F.lit, items)) if items else F.expr("cast(array() AS array<string>)")
    table = lambda get: F.create_map(*[x for place in LOCATIONS for x in (F.lit(place.id), of(get(place)))])[location]
    expands = location.isin(*[x.id for x in LOCATIONS if x.expands]) & full(F.trim(value), _REFERENCE)
    low = F.lower(name)
    named = suggests_secret(name_words(name)) & ~F.array_contains(table(lambda x: x.plain), low) & (F.length(value) >= SHORTEST) & ~full(value, "[a-z][a-z-]*")
    whole = location.isin(*[x.id for x in LOCATIONS if x.format in SOLE])
    reason = F.when(whole | F.array_contains(table(lambda x: x.fields), low), "location").when(not_secret_kind(value).isNotNull(), None)
    reason = reason.when(value_shape(F.trim(value)).isNotNull(), "shape").when(named, "name")
    return F.when((F.trim(value) != "") & ~expands, reason)


def of_locations(fields: DataFrame) -> DataFrame:
    """Credentials of standard files: source, path, name, value (null if unread), start, end, scope, reason."""
    whole = fields.filter("unread IS NOT NULL").select("path", "location", F.col("unread").alias("name"), F.lit(None).cast("string").alias("value"), "start", "end", "scope", F.lit("location").alias("reason"))
    typed = F.array_contains(F.create_map(*[x for p in LOCATIONS for x in (F.lit(p.id), F.array(*map(F.lit, p.fields)) if p.fields else F.expr("cast(array() AS array<string>)"))])[F.col("location")], F.lower("name"))
    reason = F.when(F.col("typed"), F.when(typed, "location")).otherwise(field_reason(F.col("name"), F.col("value"), F.col("location")))
    read = fields.filter("unread IS NULL").withColumn("reason", reason).filter("reason IS NOT NULL").select("path", "location", "name", "value", "start", "end", "scope", "reason")
    return read.unionByName(whole).withColumn("source", F.concat(F.lit("location:"), F.col("location"))).drop("location")


def near_miss(value: Column) -> Column:
    """Has the value a class's loose shape but not its floor: then it is that class's placeholder."""
    out = F.lit(False)
    for c in CLASSES:
        if c.exposure and c.floor is not None and not c.group:
            out = out | (full(value, c.pattern) & ~eligible(value, c))
    return out


def acceptable(value: Column, quoted: Column, code: Column) -> Column:
    """Is a value that is assigned to a secret-sounding name plausibly the secret."""
    open_ = ~quoted & (value.rlike(r"\$[A-Za-z_{(]|`") | value.rlike(r"[({\[]$"))
    expression = code & ~quoted & (full(value, _EXPRESSION) | value.contains("(") | value.contains("["))
    return (F.length(value) >= SHORTEST) & ~full(value, _PLACEHOLDER) & ~near_miss(value) & not_secret_kind(value).isNull() & ~open_ & ~expression


_ASSIGNMENT = re.compile(
    r"(?:^|(?<=[\s{,;(\[])|(?<=\\[ntr]))([\"']?)([A-Za-z_][A-Za-z0-9_.\-]*)\1[ \t]*(?::=|=>|=|:)[ \t]*"
    r"(\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'|(?:(?!\\[ntr])[^\s,;'\"\]})])+)", re.M)  # fmt: skip
_STANDALONE = {
    "jwt": re.compile(r"(?:\b|(?<=\\[ntr]))eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "url_with_password": re.compile(r"(?:\b|(?<=\\[ntr]))[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@'\"\\]*:[^\s/@'\"\\]+@[^\s'\"\\<>]+"),
    "private_key": re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z0-9 ]*PRIVATE KEY-----"),
}
_RAW = "path string, detector string, name string, value string, start int, end int, quoted boolean"


def _spans(texts: DataFrame) -> DataFrame:
    """Assignments and standalone shapes with their places: patterns whose offsets columns cannot give."""

    def cut(batches):
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
        for batch in batches:
            out = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for m in _ASSIGNMENT.finditer(text):
                    quoted = len(m[3]) > 1 and m[3][0] == m[3][-1] and m[3][0] in "'\""
                    out.append((path, "assignment", m[2], m[3][1:-1] if quoted else m[3], m.start(3) + quoted, m.end(3) - quoted, quoted))
                for name, pattern in _STANDALONE.items():
                    out += [(path, f"shape:{name}", name, m[0], m.start(), m.end(), False) for m in pattern.finditer(text)]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[c.split()[0] for c in _RAW.split(", ")])

    return texts.filter("text IS NOT NULL").select("path", "text").mapInArrow(cut, _RAW)


def detected(texts: DataFrame) -> DataFrame:
    """Finds in project texts (path, text): path, name, reason, detector, value, start, end, rank (of the name: the lower the better)."""
    code = F.lower("path").rlike("(" + "|".join(map(re.escape, CODE)) + ")$")
    raw = _spans(texts).withColumn("code", code)
    assigned = raw.filter("detector = 'assignment'").filter(suggests_secret(name_words(F.col("name"))) & acceptable(F.col("value"), F.col("quoted"), F.col("code")))
    assigned = assigned.select("path", "name", F.lit("name").alias("reason"), "detector", "value", "start", "end", F.lit(10).alias("rank"))
    shapes = raw.filter("detector <> 'assignment'").select("path", "name", F.lit("shape").alias("reason"), "detector", "value", "start", "end", F.lit(40).alias("rank"))
    found = exposure.candidates(texts.select(F.col("path").alias("surface"), F.col("path").alias("record"), "text"), tuple(c for c in CLASSES if c.exposure))
    bare = [c.name for c in CLASSES if c.floor is None and c.structure is None]
    # a class without a floor is an assignment: its value is judged like one
    before = F.col("before")
    quoted = before.rlike("['\"]$")
    triage = found.filter(F.col("class").isin(*bare) & ~F.col("dropped")).filter(acceptable(F.col("value"), quoted, F.lower("surface").rlike("(" + "|".join(map(re.escape, CODE)) + ")$")))
    triage = triage.select(F.col("surface").alias("path"), F.when(assignment_prefix(before) != "", assignment_prefix(before)).otherwise(F.col("class")).alias("name"), F.lit("name").alias("reason"), F.concat(F.lit("catalog:"), F.col("class")).alias("detector"), "value", "start", (F.col("start") + F.length("value")).alias("end"), F.lit(20).alias("rank"))
    keys = found.filter(~F.col("class").isin(*bare) & F.col("eligible"))
    keys = keys.select(F.col("surface").alias("path"), F.col("class").alias("name"), F.lit("shape").alias("reason"), F.concat(F.lit("catalog:"), F.col("class")).alias("detector"), "value", "start", (F.col("start") + F.length("value")).alias("end"), F.lit(30).alias("rank"))
    return assigned.unionByName(shapes).unionByName(triage).unionByName(keys)


def merged(finds: DataFrame) -> DataFrame:
    """Overlapping finds as one: the best namer's name, the value of the widest shape or else the namer's; then equal values of a file as one, with every place."""
    order = W.partitionBy("path").orderBy("start", F.desc("end"))
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = finds.withColumn("opens", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    namer = F.min(F.struct("rank", "start", (-F.col("end")).alias("e"), "name", "value", "reason", "end"))
    shaped = F.min(F.when(F.col("reason") == "shape", F.struct((F.col("start") - F.col("end")).alias("w"), "start", "value", "end")))
    one = rows.groupBy("path", "island").agg(namer.alias("n"), shaped.alias("s"), F.collect_set("detector").alias("detectors"))
    carrier = lambda c: F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"n.{c}"))
    one = one.select("path", F.col("n.name").alias("name"), F.col("n.rank").alias("rank"), F.when(F.col("s").isNotNull(), "shape").otherwise(F.col("n.reason")).alias("reason"), carrier("value").alias("value"), carrier("start").alias("start"), carrier("end").alias("end"), "detectors")
    best = F.min(F.struct("rank", "start", "name", "reason"))
    got = one.groupBy("path", "value").agg(best.alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("detectors")))).alias("detectors"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("places"))
    return got.select("path", "value", F.col("b.name").alias("name"), F.col("b.reason").alias("reason"), "detectors", "places")


def identified(found: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Credentials (source, path, scope, name, value) with an id each, and how many others have an equal value.

    Ids come of what names a credential; where that is not enough, -2, -3 and so on are added in a fixed order. Rows
    with the same fp are those that are linked: a value that many share costs a row each, not a list in each.
    """
    identity = F.concat_ws("\0", "source", "path", F.coalesce("scope", F.lit("")), "name")
    rows = found.withColumn("base", credential_id(identity)).join(fingerprints.select("value", "fp"), "value", "left")
    n = F.row_number().over(W.partitionBy("base").orderBy("start", "end", "fp"))
    rows = rows.withColumn("id", F.when(n > 1, F.concat_ws("-", "base", n.cast("string"))).otherwise(F.col("base"))).drop("base")
    same = rows.filter("fp IS NOT NULL").groupBy("fp").agg((F.count(F.lit(1)) - 1).alias("n_same"))
    return rows.join(same, "fp", "left").withColumn("n_same", F.coalesce("n_same", F.lit(0)))


def records(found: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """The same with the ids of all others with an equal value written out: as many as the square of those that share one."""
    rows = identified(found, fingerprints).drop("n_same")
    same = rows.filter("fp IS NOT NULL").groupBy("fp").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return rows.join(same, "fp", "left").withColumn("same_value_as", F.array_remove(F.coalesce("ids", F.array("id")), F.col("id"))).drop("ids")


def unclaimed(files: DataFrame, claimed: DataFrame) -> DataFrame:
    """Files (path) that no earlier source has read."""
    return files.join(claimed.select("path").distinct(), "path", "left_anti")


def scanned(results: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scanner results (file, line, rule, value) whose value the file (path, text) still holds, with its place; and those without file or value, with why."""
    met = results.join(texts.select(F.col("path").alias("file"), "text"), "file", "left")
    why = F.when(F.col("text").isNull(), "no_file").when(F.col("value").isNull(), "redacted").when(~F.contains("text", F.col("value")), "not_in_file")
    met = met.withColumn("why", why)
    at = F.expr("locate(value, text) - 1")
    return met.filter("why IS NULL").withColumn("start", at).withColumn("end", at + F.length("value")).drop("text", "why"), met.filter("why IS NOT NULL").drop("text")


def environment_split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries that are fine, and those of which nothing can be said; an entry that is not exported matters only if it is secret."""
    seen = judged.filter("verdict <> 'secret' AND exported")
    return seen.filter("verdict = 'not_secret'"), seen.filter("verdict = 'unknown'")


def counts(found: DataFrame) -> DataFrame:
    """By source: credentials, distinct values, files, and how many values could not be read."""
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("credentials"), F.countDistinct("fp").alias("values_seen"), F.countDistinct("path").alias("files"), F.count_if(F.col("value").isNull()).alias("unread"))


def display_path(path: Column, home: str, project: str | None = None) -> Column:
    """Paths as people write them: below the project relative, below home with ~."""
    below = lambda root: F.startswith(path, F.lit(root.rstrip("/") + "/"))
    out = F.when(below(home), F.concat(F.lit("~"), F.substring(path, len(home.rstrip("/")) + 1, 10_000)))
    if project:
        out = F.when(below(project), F.substring(path, len(project.rstrip("/")) + 2, 10_000)).otherwise(out)
    return F.coalesce(out, path)


def walked(paths: DataFrame, root: str) -> DataFrame:
    """Files of a project (path, length) with why one is not searched: in a skipped folder, in others' code, too large; sorted by whoever shows them."""
    rest = F.substring("path", len(root.rstrip("/")) + 2, 10_000)
    parts = F.split(rest, "/")
    has = lambda names: F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, names)))
    why = F.when(has(SKIPPED), "skipped").when(has(VENDORED), "vendored").when(F.col("length") > 2 << 20, "too_large")
    return paths.withColumn("unsearched", why)


__all__ = ["acceptable", "counts", "detected", "display_path", "environment_split", "field_reason", "identified", "merged", "near_miss", "of_locations", "records", "scanned", "unclaimed", "walked"]
