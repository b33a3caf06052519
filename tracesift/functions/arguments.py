"""What a tool call's arguments hold: their string leaves, and where the call sends things.

Arguments are JSON text. Both need the order of members, so they are read in Arrow batches, iteratively.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType


def string_leaves(value: object) -> list[str]:
    """Every string of a JSON value that is no key, in order."""
    out, todo = [], [value]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
        elif isinstance(at, list):
            todo.extend(reversed(at))
        elif isinstance(at, dict):
            todo.extend(reversed(list(at.values())))
    return out


def destination(value: object, keys: list[str]) -> str | None:
    """The first string under one of the keys: an object's own members in the keys' order before what is inside them.

    Objects are looked into as members or as items of a member that is a list; lists inside lists are not.
    """
    todo = [value]
    while todo:
        at = todo.pop()
        if not isinstance(at, dict):
            continue
        for key in keys:
            if isinstance(at.get(key), str):
                return at[key]
        inside = [x for member in at.values() for x in (member if isinstance(member, list) else [member])]
        todo.extend(reversed(inside))
    return None


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None


@arrow_udf(returnType=ArrayType(StringType()))
def _leaves(text: pa.Array) -> pa.Array:
    out = []
    for t in text.to_pylist():
        value = _parsed(t)
        # what is no JSON object or array is searched as it stands
        found = string_leaves(value) if isinstance(value, (dict, list)) else [t] if t is not None else []
        out.append([x.encode("utf-8", "replace").decode() for x in found])
    return pa.array(out, pa.list_(pa.string()))


def leaves(args: Column) -> Column:
    """The string leaves of arguments; of text that is no JSON, the text."""
    return _leaves(args)


def destinations(args: Column, tool: Column, sinks: dict[str, tuple[str, ...]]) -> Column:
    """Where a call to one of the sinks sends to, by that sink's keys."""

    @arrow_udf(returnType=StringType())
    def find(text: pa.Array, name: pa.Array) -> pa.Array:
        return pa.array([destination(_parsed(t), list(sinks.get(n, ()))) for t, n in zip(text.to_pylist(), name.to_pylist(), strict=True)], pa.string())

    return find(args, tool)


def flattened(text: Column) -> Column:
    """One line that cannot steer a terminal: controls, formats, separators other than the blank, and what is unassigned become blanks."""
    return F.regexp_replace(text, r"[\p{C}\p{Zl}\p{Zp}[\p{Zs}&&[^ ]]]", " ")


def escaped(text: str, most: int = 200) -> str:
    """Printable text of bounded length: what does not print is spelled as an escape."""
    out = []
    for c in text:
        code = ord(c)
        out.append(c if c.isprintable() else f"\\x{code:02x}" if code < 0x100 else f"\\u{code:04x}" if code < 0x10000 else f"\\U{code:08x}")
    flat = "".join(out)
    return flat if len(flat) <= most else flat[: most - 3] + "..."
