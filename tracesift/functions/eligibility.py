"""Does a candidate value clear its class's floor, and how it is shown: columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracesift.catalog import SourceClass

#: The heads that name a class and are safe to show, the longest first.
_HEAD = "^(?:sk-ant-(?:api|admin)[0-9]{2}-|sk-ant-|sk-(?:proj|svcacct)-|sk-|ghp_|AKIA|ASIA|AIza)"


def full(value: Column, pattern: str) -> Column:
    """Python's fullmatch: the whole value, line ends included."""
    flags = ""
    while pattern.startswith("(?i)"):
        flags, pattern = "(?i)", pattern[4:]
    return value.rlike(rf"{flags}\A(?:{pattern})\z")


def floor_prefix(value: Column) -> Column:
    """Through the last - or _ of the first 16 characters, or the first four."""
    cut = F.regexp_extract(F.substring(value, 1, 16), "(?s)^.*[-_]", 0)
    return F.when(cut == "", F.substring(value, 1, 4)).otherwise(cut)


def distinct_characters(value: Column) -> Column:
    return F.size(F.filter(F.array_distinct(F.split(value, "")), lambda c: c != ""))


def iban(value: Column) -> Column:
    """The one country whose length is known (22 characters), with remainder 1 by 97."""
    turned = F.concat(F.substring(value, 5, 18), F.substring(value, 1, 4))
    digits = turned
    for k in range(26):
        digits = F.replace(digits, F.lit(chr(65 + k)), F.lit(str(10 + k)))
    return full(value, "DE[0-9]{20}") & ((digits.cast("decimal(38,0)") % 97) == 1)


def eligible(value: Column, of: SourceClass) -> Column:
    """Floor, distinct characters after the head, rejected placeholders; no floor is never eligible."""
    if of.structure == "iban":
        ok = iban(value)
    elif of.floor is not None:
        ok = full(value, of.floor)
    else:
        return F.lit(False)
    if of.distinct is not None:
        rest = F.substring(value, F.length(floor_prefix(value)) + 1, F.length(value))
        ok = ok & (distinct_characters(rest) >= of.distinct)
    return ok & ~rejected(value, of)


def rejected(value: Column, of: SourceClass) -> Column:
    out = F.lit(False)
    for p in of.rejects:
        out = out | full(value, p)
    return out


def class_prefix(value: Column) -> Column:
    head = F.regexp_extract(value, _HEAD, 0)
    return F.when(head == "", F.substring(value, 1, 4)).otherwise(head)


def fingerprint(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 12)


def canon(value: Column) -> Column:
    """Upper case without blanks and hyphens: how values are compared in flows."""
    return F.translate(F.upper(value), " -", "")


def mask(value: Column) -> Column:
    return F.when(F.length(value) <= 8, F.concat(F.substring(value, 1, 2), F.lit("..."))).otherwise(F.concat(F.substring(value, 1, 4), F.lit("..."), F.substring(value, -4, 4)))


def distinctive_tokens(text: Column, least: int = 8) -> Column:
    """Whole tokens of some length that are not bare integers, each once, sorted."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z0-9][A-Za-z0-9._@+-]*+"), 0)
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= least) & ~t.rlike("^[0-9]+$"))))


def matched_value(value: Column, of: SourceClass) -> Column:
    """Percent escapes undone where the class says so; a plus sign and a stray % stay."""
    if not of.percent_decoded:
        return value
    strays = F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(strays, F.lit("+"), F.lit("%2B"))), value)


def assignment_prefix(key_text: Column) -> Column:
    """The name of an assignment: its words without quotes, operators and list punctuation, joined by ': '."""
    words = F.split(F.regexp_replace(key_text, r"(?s)\[.*,", "["), r"(?:[\s\"'=:,\[+]|%20|%3[Aa]|\\+[ntr]?)+")
    return F.array_join(F.filter(words, lambda w: (w != "") & (F.lower(w) != "b")), ": ")
