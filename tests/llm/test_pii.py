"""Personal data: base spans against Python's re on random texts; terms on a planted corpus."""

import hashlib
import random
import re

from tracesift.llm import pii

#: Fixed: the patterns as the task states them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, source string"


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def random_text(rng):
    parts = ["a@b.c", "@", ".", "_", "-", " ", "  ", "+", "é", "😀", "x", "1", "25", "255", "256", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", "(555)", "+1 (555) 555-0100", "\n", "0", "99"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))


def test_base_spans_are_those_of_the_stated_patterns(spark):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(3000)] + [None, "", "7" * 30000, "a." * 30000 + "@", "a@" + "b." * 20000 + "c", "+" + "1 " * 20000, "1.2.3.4.5.6.7.8", "4111111111111111" * 3]
    got = {r.doc_id: r for r in pii.find(spark, spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], SCHEMA)).collect()}
    for k, t in enumerate(texts):
        want = base(t)
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t or "")[:200]
        assert [got[k][f"n_{kind}"] for kind in PATTERNS] == [sum(x.startswith(kind) for x in want.split(",")) for kind in PATTERNS]


def planted():
    rows = [(k, f"common words stand here number{k} and nothing else", "s") for k in range(40)]
    rows += [(100 + k, f"filler{k} words: Zorblax wrote to jo@ex.org common yesterday{k}", "s") for k in range(4)]
    rows += [(200, "Zorblax alone, without an address", "s"), (None, None, None), (201, "", "s")]
    return rows


def test_terms_that_give_an_entity_away_are_struck(spark):
    docs = spark.createDataFrame(planted(), SCHEMA)
    spans = {r.doc_id: r.spans for r in pii.find(spark, docs).collect()}
    text = planted()[40][1]
    email, term = text.index("jo@"), text.index("Zorblax")
    wrote = text.index("wrote")
    assert spans[100] == f"term:{term}:{term + 7},term:{wrote}:{wrote + 5},email:{email}:{email + 9}"
    assert spans[200] == "" and spans[None] == "" and spans[0] == ""
    kept = {r.doc_id: r for r in pii.sanitise(spark, docs).collect()}
    assert len(kept) == len(planted()) and kept[200].text == planted()[44][1] and kept[None].text is None
    assert "jo@" not in kept[101].text and "Zorblax" not in kept[101].text and "[EMAIL]" in kept[101].text and "common" in kept[101].text


def test_copies_of_one_text_are_no_evidence(spark):
    docs = spark.createDataFrame([(k, "Zorblax wrote to jo@ex.org", "s") for k in range(9)] + [(50 + k, f"other {k}", "s") for k in range(9)], SCHEMA)
    assert {r.spans for r in pii.find(spark, docs).collect()} == {"email:17:26", ""}


def test_terms_far_from_the_entity_and_at_the_ends_of_a_text_count(spark):
    far = "plain words of no weight " * 20
    rows = [(k, f"Zorblax: {far}row{k} jo@ex.org Quimby", "s") for k in range(4)] + [(50 + k, f"{far}other {k}", "s") for k in range(40)]
    kept = {r.doc_id: r.text for r in pii.sanitise(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [kept[k] for k in range(4)] == [f": {far}row{k} [EMAIL] " for k in range(4)]
    assert [kept[50 + k] for k in range(40)] == [f"{far}other {k}" for k in range(40)]


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.find(spark, empty).count() == 0
    assert pii.sanitise(spark, empty).columns == ["doc_id", "text", "source"]
