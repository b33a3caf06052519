"""Every string and key of a JSON value with its path, iteratively, so that nesting takes no stack."""

from __future__ import annotations

import json
from collections.abc import Iterator

Path = tuple[str | int, ...]


def strings(value: object) -> Iterator[tuple[Path, str, bool]]:
    """(path, text, is_key) in document order."""
    todo: list[tuple[Path, object, bool]] = [((), value, False)]
    while todo:
        path, at, is_key = todo.pop()
        if isinstance(at, str):
            yield path, at, is_key
        elif isinstance(at, list):
            todo.extend(((*path, k), x, False) for k, x in reversed(list(enumerate(at))))
        elif isinstance(at, dict):
            for k, x in reversed(list(at.items())):
                todo.append(((*path, k), x, False))
                todo.append(((*path, k), k, True))


def any_value(value: object) -> object:
    """A telemetry AnyValue wrapper as plain JSON; what is no wrapper stays as it is. Key-value lists become objects."""
    if not isinstance(value, dict) or len(value) != 1:
        return value
    (kind, inner), = value.items()
    if kind in ("stringValue", "boolValue", "doubleValue", "bytesValue"):
        return inner
    if kind == "intValue":
        return int(inner) if str(inner).lstrip("-").isdigit() else inner
    if kind == "arrayValue" and isinstance(inner, dict):
        return [any_value(x) for x in inner.get("values") or []]
    if kind == "kvlistValue" and isinstance(inner, dict):
        return {x.get("key"): any_value(x.get("value")) for x in inner.get("values") or [] if isinstance(x, dict)}
    return value


def shown(path: Path) -> str:
    """a.b[0]"""
    return "".join(f"[{x}]" if isinstance(x, int) else f".{x}" for x in path).removeprefix(".")


def parsed(text: str | bytes) -> tuple[object, str | None]:
    """The JSON value, or why there is none: truncated text ends too early or inside a string; else unparseable."""
    try:
        return json.loads(text), None
    except UnicodeDecodeError:
        return None, "invalid_utf8"
    except RecursionError:
        return None, "too_deep"
    except json.JSONDecodeError as e:
        cut = e.msg.startswith("Unterminated string") or e.pos >= len(e.doc.rstrip())
        return None, "truncated" if cut else "unparseable"
