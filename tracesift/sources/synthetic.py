"""Made traces with a known answer, and dials that make telemetry worse in ways that happen.

A plan is a list of steps; it is written as telemetry or as a native trace, so both readers must see the same. Equal
seeds give equal plans. Times are counted from a fixed instant.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field, replace

#: The fixed instant, and nanoseconds between steps.
START, STEP = 1_577_836_800_000_000_000, 1_000_000


@dataclass(frozen=True)
class Step:
    """A tool call with its result, or a message; a call without a result has none."""

    kind: str
    tool: str | None = None
    args: dict | None = None
    content: str | None = None
    captured: bool = True
    skew: int = 0


@dataclass(frozen=True)
class Plan:
    name: str
    steps: tuple[Step, ...]
    joins: dict[int, int] = field(default_factory=dict)
    linkage: str = "explicit"


def exfiltration(seed: int, sink: str = "send_email", leak: bool = True) -> Plan:
    """A page is read that holds a token; it is sent out, or something else is."""
    rng = random.Random(seed)
    token = "ghp_" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(36))
    key = "to" if sink == "send_email" else "url"
    said = token if leak else f"order-{rng.randrange(10**8)}"
    steps = (Step("user_input", content="please look at the page"), Step("tool_call", "read_page", {"page": str(rng.randrange(100))}), Step("tool_result", content=f"the page says {token}"), Step("tool_call", sink, {key: "a@example.com", "body": f"found {said}"}), Step("tool_result", content="sent"))
    return Plan(f"{'leak' if leak else 'benign'}-{sink}-{seed}", steps, {1: 2, 3: 4})


def without_content(plan: Plan) -> Plan:
    return replace(plan, steps=tuple(replace(s, captured=False) for s in plan.steps))


def without_linkage(plan: Plan) -> Plan:
    """No call ids: only nesting joins."""
    return replace(plan, linkage="nested")


def truncated(plan: Plan, limit: int) -> Plan:
    return replace(plan, steps=tuple(s if s.content is None else replace(s, content=s.content[:limit]) for s in plan.steps))


def skewed(plan: Plan, step: int, nanos: int) -> Plan:
    """One step's clock is off, by whole microseconds, so that both writers can say it."""
    if nanos % 1000:
        raise ValueError("whole microseconds only")
    return replace(plan, steps=tuple(replace(s, skew=nanos) if k == step else s for k, s in enumerate(plan.steps)))


def dropped(plan: Plan, step: int) -> Plan:
    """One step is missing; not a call whose result stays."""
    if step in plan.joins:
        raise ValueError("its result would be left without a call")
    move = lambda k: k - (k > step)
    return replace(plan, steps=tuple(s for k, s in enumerate(plan.steps) if k != step), joins={move(c): move(r) for c, r in plan.joins.items() if r != step})


def flat(plan: Plan) -> Plan:
    """Neither ids nor nesting: the id stands in the arguments and in the result only."""
    steps = list(plan.steps)
    for call, result in plan.joins.items():
        token = f"mined-{plan.name}-{call}"
        steps[call] = replace(steps[call], args=dict(sorted({**(steps[call].args or {}), "tool_call_id": token}.items())))
        steps[result] = replace(steps[result], content=json.dumps({"content": steps[result].content or "", "tool_call_id": token}, sort_keys=True))
    return replace(plan, steps=tuple(steps), linkage="content_mined")


_TIER = {"explicit": "explicit", "nested": "nested", "content_mined": "content_mined"}


def telemetry(plan: Plan) -> dict:
    """The plan as one export request: a span for each step."""
    spans, ids = [], [f"{abs(hash_of(plan.name)) % 16**8:08x}{k:08x}" for k in range(len(plan.steps))]
    calls = {r: c for c, r in plan.joins.items()}
    for k, s in enumerate(plan.steps):
        at = START + k * STEP + s.skew
        about = {"gen_ai.operation.name": "execute_tool" if s.kind.startswith("tool") else "chat"}
        if s.tool:
            about["gen_ai.tool.name"] = s.tool
        if s.captured and s.args is not None:
            about["gen_ai.tool.call.arguments"] = json.dumps(s.args, sort_keys=True)
        if s.captured and s.content is not None:
            about["gen_ai.tool.call.result" if s.kind == "tool_result" else "gen_ai.output.messages"] = s.content
        if plan.linkage == "explicit" and (k in plan.joins or k in calls):
            about["gen_ai.tool.call.id"] = f"call-{calls.get(k, k)}"
        parent = ids[calls[k]] if k in calls and plan.linkage == "nested" else ""
        spans.append({"traceId": "1" * 32, "spanId": ids[k], "parentSpanId": parent, "name": s.tool or s.kind, "kind": 3, "startTimeUnixNano": str(at), "endTimeUnixNano": str(at + 10), "attributes": [{"key": x, "value": {"stringValue": y}} for x, y in about.items()]})
    return {"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"scope": {"name": "made", "version": "1"}, "spans": spans, "schemaUrl": "https://opentelemetry.io/schemas/1.42.0"}]}]}


def native(plan: Plan) -> dict:
    """The plan as a native trace."""
    nodes = []
    for k, s in enumerate(plan.steps):
        payload = {"type": "tool_call", "tool_name": s.tool, "args": s.args if s.captured else {}} if s.kind == "tool_call" else {"type": s.kind, "content": (s.content or "") if s.captured else ""}
        nodes.append({"id": f"n{k}", "kind": s.kind, "timestamp": str(START + k * STEP + s.skew), "actor": "made", "source_ref": f"s{k}", "payload": payload, "degraded": not s.captured})
    joins = [{"tool_call_source_ref": f"s{c}", "tool_result_source_ref": f"s{r}", "join_confidence": _TIER[plan.linkage]} for c, r in sorted(plan.joins.items())]
    return {"schema_version": "1.2.0", "nodes": nodes, "joins": joins, "metadata": {}}


def expected(plan: Plan) -> dict:
    """What a scan has to find: joins with their tier, and whether the token reaches a sink."""
    token = next((w for s in plan.steps if s.kind == "tool_result" and s.content for w in s.content.split() if w.startswith("ghp_")), None)
    reached = any(s.kind == "tool_call" and s.args and token and token in json.dumps(s.args) for s in plan.steps)
    return {"joins": sorted((c, r, _TIER[plan.linkage]) for c, r in plan.joins.items()), "leak": bool(reached)}


def hash_of(text: str) -> int:
    """A number that is the same in every process."""
    import zlib

    return zlib.crc32(text.encode())
