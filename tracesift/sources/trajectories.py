"""Message lists of agent runs and of model requests: to trace nodes and joins, and to the tools that results answer."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_NODE = "trace string, idx int, node_id string, kind string, tool_name string, call_id string, content string, args string, result_of int"
_RESULT = "request string, call_id string, tools array<string>"


def _text(content: object) -> str:
    """A message's content as text: a string, or the texts of its blocks."""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "".join(x if isinstance(x, str) else x.get("text", "") if isinstance(x, dict) and isinstance(x.get("text"), str) else "" for x in content)
    return "" if content is None else json.dumps(content)


def nodes_of(messages: list) -> list[tuple]:
    """(kind, tool, call id, content, args, position of the call a result answers) in the order of the messages."""
    out: list[tuple] = []
    calls: dict[str, int] = {}
    for m in messages:
        if not isinstance(m, dict):
            continue
        role, content = m.get("role"), _text(m.get("content"))
        if role in ("system", "user"):
            out.append(("user_input", None, None, content, None, None))
        elif role == "assistant":
            if content:
                out.append(("llm_call", None, None, content, None, None))
            for c in m.get("tool_calls") or []:
                made = c.get("function")
                name, args = (made.get("name"), made.get("arguments")) if isinstance(made, dict) else (made, c.get("args"))
                if isinstance(c.get("id"), str):
                    calls[c["id"]] = len(out)
                out.append(("tool_call", name, c.get("id"), None, args if isinstance(args, str) else json.dumps(args or {}), None))
        elif role == "tool":
            out.append(("tool_result", None, m.get("tool_call_id"), content, None, calls.get(m.get("tool_call_id"))))
    return out


def nodes(runs: DataFrame) -> DataFrame:
    """trace, messages (JSON) to a row for each node; results name the position of the call they answer: an explicit join."""

    def cut(batches):
        types = [pa.string(), pa.int32(), *[pa.string()] * 6, pa.int32()]
        for batch in batches:
            out = []
            for trace, text in zip(batch.column("trace").to_pylist(), batch.column("messages").to_pylist(), strict=True):
                value = json.loads(text)
                found = nodes_of(value if isinstance(value, list) else value.get("messages") or [])
                out += [(trace, k, f"n{k}", kind, tool, call, content, args, of) for k, (kind, tool, call, content, args, of) in enumerate(found)]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[c.split()[0] for c in _NODE.split(", ")])

    return runs.select("trace", "messages").mapInArrow(cut, _NODE)


def _items(value: object) -> Iterator[dict]:
    return (x for x in (value if isinstance(value, list) else []) if isinstance(x, dict))


def results_of(request: dict) -> list[tuple[str, list[str]]]:
    """(call id, names of the tool) of every tool result that a model request sends back, in any of three dialects."""
    calls: dict[str, set[str]] = {}
    found: list[tuple[object, set[str]]] = []

    def made(call: object, name: object) -> None:
        if isinstance(call, str):
            calls.setdefault(call, set()).update({name} if isinstance(name, str) else ())

    names = lambda x: {x} if isinstance(x, str) else set()
    for m in _items(request.get("messages")):
        if m.get("role") == "assistant":
            for c in _items(m.get("tool_calls")):
                made(c.get("id"), c["function"].get("name") if isinstance(c.get("function"), dict) else None)
        elif m.get("role") == "tool":
            found.append((m.get("tool_call_id"), names(m.get("name"))))
        for block in _items(m.get("content")):
            if block.get("type") == "tool_use":
                made(block.get("id"), block.get("name"))
            elif block.get("type") == "tool_result":
                found.append((block.get("tool_use_id"), set()))
    for item in _items(request.get("input")):
        kind = item.get("type")
        if kind in ("function_call", "custom_tool_call"):
            made(item.get("call_id"), item.get("name"))
        elif isinstance(kind, str) and kind.endswith("_call_output"):
            found.append((item.get("call_id"), names(item.get("name"))))
    return [(call, sorted(own | calls.get(call, set()))) for call, own in found if isinstance(call, str)]


def results(requests: DataFrame) -> DataFrame:
    """request, body (JSON) to the tool results each sends back."""

    def cut(batches):
        for batch in batches:
            out = []
            for request, body in zip(batch.column("request").to_pylist(), batch.column("body").to_pylist(), strict=True):
                try:
                    value = json.loads(body)
                except (TypeError, ValueError):
                    value = None
                out += [(request, c, t) for c, t in results_of(value)] if isinstance(value, dict) else []
            yield pa.record_batch([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.list_(pa.string()))], names=["request", "call_id", "tools"])

    return requests.select("request", "body").mapInArrow(cut, _RESULT)
