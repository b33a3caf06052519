"""Personal data: patterns, and the terms whose company gives an entity away. DataFrame functions only.

Emails, IP addresses, card and phone numbers are found by patterns. Their values are the protected entities, and
so are the domains of emails, so that addresses of one organisation share their evidence. For a term t and an
entity e that stand in one document, however far apart, counts over all documents give
PMI(t, e) = log2(N n(t, e) / (n(t) n(e))), and the share it reveals of the entity's information
IC(e) = log2(N / n(e)); at 1 the term occurs with the entity only. Terms seen with an entity in enough
different texts are generalised to their kind from one share on and removed from a higher one on, wherever
they stand in a document that holds the entity. Terms are words, compared in lower case.

Only documents with an entity are kept with their text; term counts cover every document, aggregated before
they are shuffled. Pairs are the distinct entities and distinct terms of each distinct text. As n(t, e) is at most
n(e), a share of g needs n(t) <= n(e)^g N^(1-g): terms above that for every entity make no pairs, and nothing is lost.
Entities of fewer texts than a pair needs make none either.

Patterns are written so that a failing start is not tried again inside the same run and no group recurses: long runs
take linear time and no stack. Offsets are running sums made in stretches of STRETCH spans, and texts are rewritten by
such stretches, so thousands of spans in one text cost little more than their number.

Defined cases: a null or empty text has no spans; repeated rows get equal spans; a share that reaches both limits
removes; further columns are ignored, or kept where texts are rewritten; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, text_key

#: Letters a term has at least.
LETTERS = 3
#: Spans whose offsets are summed, or which are replaced, at once.
STRETCH = 64
#: Different texts that must show a term with an entity, and the shares that generalise and remove it.
SUPPORT, GENERALISE, REMOVE = 3, 0.7, 0.9

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # runs of digits with single blanks or hyphens between, whole: others than of 12 to 19 digits are no match
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_GATES = {"email": "contains(text, '@')", "ip": "text rlike '[0-9][.][0-9]'", "card": "text rlike '[0-9][ -]?[0-9]'", "phone": "contains(text, '+')"}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_LUHN = """aggregate(sequence(1, length(d)), 0, (a, k) -> a + CASE WHEN (length(d) - k) % 2 = 0 THEN cast(substr(d, k, 1) AS int)
  WHEN cast(substr(d, k, 1) AS int) > 4 THEN 2 * cast(substr(d, k, 1) AS int) - 9 ELSE 2 * cast(substr(d, k, 1) AS int) END) % 10 = 0"""
_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": rf"x.value rlike r'\A{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z'",
    "card": _LUHN.replace("length(d)", f"length({_DIGITS})").replace("(d,", f"({_DIGITS},"),
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
_SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string, value: string>"
_WORD, _GAP = r"r'[\p{L}\p{N}]++'", r"r'[^\p{L}\p{N}]++'"


def _let(name: str, value: str, then: str) -> str:
    """SQL: `then`, with `value` made once under a name."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _found(text: str, pattern: str, rank: int, kind: str) -> str:
    """SQL: all matches of a pattern with their offsets in code points, from the pieces between them."""
    size = "length(x.`0`) + coalesce(length(x.`1`), 0)"
    span = f"named_struct('start', a.at + length(x.`0`), 'rank', {rank}, 'end', a.at + {size}, 'kind', '{kind}', 'value', x.`1`)"
    stretch = f"""aggregate(slice(z, c * {STRETCH} + 1, {STRETCH}),
      named_struct('at', aggregate(slice(z, 1, c * {STRETCH}), 0L, (a, x) -> a + {size}), 'list', cast(array() AS array<{_SPAN}>)),
      (a, x) -> named_struct('at', a.at + {size}, 'list', if(x.`1` IS NULL, a.list, concat(a.list, array({span})))), a -> a.list)"""
    each = f"flatten(transform(sequence(0, (size(z) - 1) div {STRETCH}), c -> {stretch}))"
    return _let("z", f"arrays_zip(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0))", each)


def base_spans() -> Column:
    """Spans of all kinds in the column `text`, by start and then kind."""
    each = []
    for rank, kind in enumerate(KINDS):
        found = _found("text", f"r'{PATTERNS[kind]}'", rank, kind)
        each.append(f"CASE WHEN {_GATES[kind]} THEN filter({found}, x -> {_VALID[kind]}) ELSE cast(array() AS array<{_SPAN}>) END")
    return F.expr(f"CASE WHEN text IS NULL THEN cast(array() AS array<{_SPAN}>) ELSE array_sort(concat({', '.join(each)})) END")


def _merged(spans: str, label: str) -> str:
    """SQL: spans (by start) as disjoint (s, e, label): those that overlap reach from the first start to the last end under the first one's label."""
    step = f"named_struct('top', greatest(a.top, x.end), 'list', if(x.start < a.top, a.list, concat(a.list, array(named_struct('s', x.start, 'before', a.top, 'label', {label})))))"
    stretch = f"""aggregate(slice(v, c * {STRETCH} + 1, {STRETCH}), named_struct('top', aggregate(slice(v, 1, c * {STRETCH}), 0L, (a, x) -> greatest(a, x.end)),
      'list', cast(array() AS array<struct<s: bigint, before: bigint, label: string>>)), (a, x) -> {step}, a -> a.list)"""
    opened = f"flatten(transform(sequence(0, (size(v) - 1) div {STRETCH}), c -> {stretch}))"
    # what ran before a span that opens a group ends the group before it
    whole = "transform(o, (x, i) -> named_struct('s', x.s, 'e', if(i + 1 < size(o), get(o, i + 1).before, array_max(transform(v, y -> y.end))), 'label', x.label))"
    return _let("v", spans, f"CASE WHEN size(v) = 0 THEN cast(array() AS array<struct<s: bigint, e: bigint, label: string>>) ELSE {_let('o', opened, whole)} END")


def _between(spans: str, inner: str) -> str:
    """SQL: the column `text` with each of the disjoint spans x (s, e, label) replaced by `inner`."""
    first = f"if(c = 0, 0L, get(m, c * {STRETCH} - 1).e)"
    last = f"get(m, least(size(m), c * {STRETCH} + {STRETCH}) - 1).e"
    part = f"named_struct('b', {first}, 't', substring(text, cast({first} AS int) + 1, cast({last} - {first} AS int)))"
    before = f"if(i = 0, q.b, get(m, c * {STRETCH} + i - 1).e)"
    piece = f"concat(substring(q.t, cast({before} - q.b AS int) + 1, cast(x.s - {before} AS int)), {inner})"
    stretch = _let("q", part, f"array_join(transform(slice(m, c * {STRETCH} + 1, {STRETCH}), (x, i) -> {piece}), '')")
    all_ = f"concat(array_join(transform(sequence(0, (size(m) - 1) div {STRETCH}), c -> {stretch}), ''), substring(text, cast(get(m, size(m) - 1).e AS int) + 1))"
    return _let("m", spans, f"CASE WHEN size(m) = 0 THEN text ELSE {all_} END")


#: SQL: the text with blanks for its base spans, so that every other offset stays.
_MASKED = _between(_merged("base", "''"), "repeat(' ', cast(x.e - x.s AS int))")


def base_table(scratch: Scratch, docs: DataFrame, columns: list[str]) -> DataFrame:
    """Stored: for each document its columns as one (`row`), a stable number, its base spans, and its text if it has any."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text")).withColumn("base", base_spans())
    kept = rows.select("row", F.monotonically_increasing_id().alias("rid"), "base", F.when(F.size("base") > 0, F.col("text")).alias("text"))
    return scratch.write(kept, "base")


def _entities() -> Column:
    """The names of the entities in `base`, each once: values by kind, and the domains of emails."""
    names = "array(concat_ws(':', x.kind, lower(x.value)), if(x.kind = 'email', concat('domain:', lower(substring_index(x.value, '@', -1))), NULL))"
    return F.expr(f"array_distinct(filter(flatten(transform(base, x -> {names})), n -> n IS NOT NULL))")


def _terms(text: str) -> Column:
    """The words of a text in lower case, each once."""
    return F.expr(f"filter(array_distinct(transform(split({text}, {_GAP}), w -> lower(w))), w -> length(w) >= {LETTERS})")


def disclosing(scratch: Scratch, docs: DataFrame, base: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(entity, term, share, action) of the terms that reveal an entity."""
    some = base.filter("size(base) > 0")
    held = scratch.write(some.select("rid", text_key().alias("key"), F.explode(_entities()).alias("entity")), "held")
    entities = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.countDistinct("key").alias("texts"))
    # an entity of fewer texts has no term with enough of them; of equal texts one stands for all
    enough = scratch.write(entities.filter(F.col("texts") >= support).select("entity", "n_entity"), "enough")
    copies = held.select("rid", "key").distinct().groupBy("key").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies")).select("rid", "copies")
    used = scratch.write(held.select("rid", "entity").join(copies, "rid").join(enough, "entity"), "used")
    total = float(max(base.count(), 1))
    largest = enough.agg(F.max("n_entity").alias("n")).first()["n"] or 0
    bound = lambda n: F.pow(n.cast("double"), F.lit(generalise)) * total ** (1 - generalise) * (1 + 1e-9) + 1e-6
    terms = docs.select(F.explode(_terms("text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    rare = terms.filter(F.col("n_term") <= bound(F.lit(largest)))
    held_terms = some.join(used.select("rid").distinct(), "rid", "left_semi").withColumn("masked", F.expr(_MASKED)).select("rid", F.explode(_terms("masked")).alias("term"))
    pairs = held_terms.join(rare, "term").join(used, "rid").filter(F.col("n_term") <= bound(F.col("n_entity")))
    joint = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support).drop("texts")
    pmi = F.log2(F.lit(total) * F.col("n_both") / F.col("n_term") / F.col("n_entity"))
    ic = F.log2(F.lit(total) / F.col("n_entity"))
    found = joint.withColumn("share", F.when(ic > 0, pmi / ic).otherwise(0.0))
    action = F.when(F.col("share") >= remove, "remove").otherwise("generalise")
    return scratch.write(found.filter(F.col("share") >= generalise).select("entity", "term", "share", action.alias("action")), "disclosing")


def with_terms(scratch: Scratch, base: DataFrame, found: DataFrame) -> DataFrame:
    """The base table's rows with a map `terms` of the terms to be struck in each document to what is done, or null."""
    held = base.filter("size(base) > 0").select("rid", F.explode(_entities()).alias("entity"))
    # removal goes before generalisation where a term reveals two entities
    struck = held.join(found, "entity").groupBy("rid", "term").agg(F.max("action").alias("action")).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("terms"))
    return base.join(scratch.write(struck, "struck"), "rid", "left")


def _term_spans() -> Column:
    """Spans (start, rank, end, kind, value) of the terms in `terms`, outside the base spans; value is the action."""
    found = _found("t", _WORD, len(KINDS), "term")
    one = "transform(filter(w, x -> map_contains_key(terms, lower(x.value))), x -> named_struct('start', x.start, 'rank', x.rank, 'end', x.end, 'kind', x.kind, 'value', element_at(terms, lower(x.value))))"
    return F.expr(f"CASE WHEN terms IS NULL THEN cast(array() AS array<{_SPAN}>) ELSE {_let('t', _MASKED, _let('w', found, one))} END")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and all spans of every document."""
    scratch = Scratch(spark, "pii")
    base = base_table(scratch, docs, ["doc_id"])
    rows = with_terms(scratch, base, disclosing(scratch, docs, base)).withColumn("added", _term_spans())
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return rows.select("row.doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


def sanitise(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with entities replaced by their kind and disclosing terms generalised or removed.

    Rows without spans pass as they are, without a shuffle.
    """
    scratch = Scratch(spark, "pii")
    others = [c for c in docs.columns if c != "text"]
    base = base_table(scratch, docs, others)
    rows = with_terms(scratch, base.filter("size(base) > 0"), disclosing(scratch, docs, base)).withColumn("added", _term_spans())
    label = "CASE WHEN x.kind <> 'term' THEN concat('[', upper(x.kind), ']') WHEN x.value = 'remove' THEN '' ELSE '[TERM]' END"
    spans = _merged("array_sort(concat(base, added))", label)
    struck = rows.withColumn("text", F.expr(_between(spans, "x.label")))
    struck = struck.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text").withColumn("base", base_spans())
    return plain.filter("size(base) = 0").select("row.*").unionByName(struck)


def op3_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark, table(spark, sf_dir, "documents"))
