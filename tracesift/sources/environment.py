"""Environment files and shell startup files to names and values, with what could not be read counted.

Values keep their character spans, so that what is judged can be found again. A value made by an expansion or
a command is not literal: its name alone is judged. Texts are cut on the executors, a file at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENTRY = "file string, name string, value string, start int, end int, exported boolean, literal boolean, unread string"
_NAME = re.compile(r"[ \t]*(?:(export|declare|typeset|local|setenv)[ \t]+(?:-[A-Za-z]+[ \t]+)*)?([A-Za-z_][A-Za-z0-9_.]*)(=|[ \t]+)")
_FISH = re.compile(r"[ \t]*set[ \t]+((?:-[-A-Za-z]+[ \t]+)+)([A-Za-z_][A-Za-z0-9_]*)[ \t]+")
_HEREDOC = re.compile(r"<<-?[ \t]*(['\"]?)([A-Za-z_]+)\1")
_DYNAMIC = re.compile(r"\$[A-Za-z_{(]|`")


def _value(text: str, at: int) -> tuple[str, int, int, bool, str | None]:
    """(value, start, end, literal, unread) of what stands at a position: quoted over lines, or a bare word."""
    if at < len(text) and text[at] in "'\"":
        quote, k, out = text[at], at + 1, []
        while k < len(text) and text[k] != quote:
            if quote == '"' and text[k] == "\\" and k + 1 < len(text):
                k += 1
            out.append(text[k])
            k += 1
        value = "".join(out)
        return value, at + 1, k, quote == "'" or not _DYNAMIC.search(value), None if k < len(text) else "open_quote"
    m = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z0-9 ]*PRIVATE KEY-----").match(text, at)
    end = m.end() if m else at
    while not m and end < len(text) and text[end] not in "\r\n" and not (text[end] in " \t;" and text[end - 1] != "\\"):
        end += 1
    value = text[at:end]
    return value, at, end, not _DYNAMIC.search(value), None


def entries(text: str) -> list[tuple]:
    """(name, value, start, end, exported, literal, unread) in order."""
    if "\0" in text:  # the form `env -0` prints
        out, at = [], 0
        for part in text.split("\0"):
            name, eq, value = part.partition("=")
            if eq:
                out.append((name, value, at + len(name) + 1, at + len(part), True, True, None))
            at += len(part) + 1
        return out
    out, at, until = [], 0, None
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if until is not None:
            until = None if line.strip() == until else until
            at = end + 1
            continue
        fish, m = _FISH.match(text, at), _NAME.match(text, at)
        found = None if line.lstrip().startswith("#") else fish or (m if m and (m[3] == "=" or m[1] == "setenv") else None)
        if found:
            value, a, b, literal, unread = _value(text, found.end())
            exported = "x" in fish[1] if fish else m[1] in ("export", "setenv") or (m[1] is not None and "-x" in m[0])
            out.append((found[2], value, a, b, exported, literal, unread))
            end = text.find("\n", b)
            end = len(text) if end < 0 else end
        here = _HEREDOC.search(line)
        if here and not found:
            until = here[2]
            out.append((None, None, at, end, False, False, "heredoc"))
        at = end + 1
    return out


def read(files: DataFrame) -> DataFrame:
    """path, content -> a row for each entry; a binary or undecodable file is one unread row."""

    def cut(batches):
        import pyarrow as pa

        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = [(path, *e) for e in entries(content.decode())]
                except UnicodeDecodeError:
                    rows = [(path, None, None, None, None, None, None, "undecodable")]
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split()[0] for c in _ENTRY.split(", ")])

    return files.select("path", "content").mapInArrow(cut, _ENTRY)


def judged(found: DataFrame) -> DataFrame:
    """Entries with verdict and reason; values that are not literal are judged by name."""
    from tracesift.functions.names import classify

    c = classify(F.col("name"), F.when(F.col("literal"), F.col("value")))
    return found.filter("name IS NOT NULL").withColumn("c", c).select("file", "name", "start", "end", F.length("value").alias("value_len"), "exported", F.col("c.verdict").alias("verdict"), F.col("c.why").alias("why"), "unread")
