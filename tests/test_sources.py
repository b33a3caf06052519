"""Readers and incremental operators on small files of our own."""

import json

import pytest
from pyspark.sql import functions as F

from tracesift.operators import exposure, facts, judge, redact, sessions
from tracesift.plans import scan as plans
from tracesift.sources import captures, environment, lines, native, otlp
from tracesift.streaming import sessions as stream_sessions
from tracesift.streaming import tool_ledger

TOKEN = "ghp_aB3dE5gH7jK9mN1pQ2rS4tU6vW8xY0zA1bC3"


def span(span_id, start, parent=None, **attributes):
    return {"traceId": "t1", "spanId": span_id, "parentSpanId": parent, "name": "n", "kind": "SPAN_KIND_CLIENT", "startTimeUnixNano": str(start), "endTimeUnixNano": str(start + 5), "attributes": [{"key": k.replace("__", "."), "value": {"stringValue": v}} for k, v in attributes.items()]}


def export(*spans, snake=False):
    names = ("resource_spans", "scope_spans") if snake else ("resourceSpans", "scopeSpans")
    return {names[0]: [{names[1]: [{"scope": {"name": "s"}, "spans": list(spans)}]}]}


def test_telemetry_to_nodes_joins_and_findings(spark, tmp_path):
    tool = {"gen_ai__operation__name": "execute_tool"}
    call = span("a", 10, **tool, gen_ai__tool__name="read", gen_ai__tool__call__id="c1", gen_ai__tool__call__arguments='{"q": 1}', gen_ai__tool__call__result=f"found order-99812 and {TOKEN}")
    send = span("b", 30, **tool, gen_ai__tool__name="send_email", gen_ai__tool__call__id="c2", gen_ai__tool__call__arguments=json.dumps({"to": "x", "body": "about order-99812"}))
    cut = span("c", 40, **tool, gen_ai__tool__name="send_email", gen_ai__tool__call__arguments='{"to": "x')
    (tmp_path / "one.json").write_text(json.dumps(export(call, call, send)))
    (tmp_path / "two.jsonl").write_text("﻿" + json.dumps(export(cut, span("d", 50), 7, snake=True)) + "\n{not json\n" + '{"other": 1}\n')
    out = plans.scan(spark, tmp_path.as_uri())
    nodes = [(r.idx, r.node_id, r.kind, r.degraded) for r in out["nodes"].orderBy("idx").collect()]
    assert nodes == [(0, "a", "tool_call", False), (1, "a#result", "tool_result", False), (2, "b", "tool_call", False), (3, "c", "tool_call", True)]
    assert [(r.call_idx, r.result_idx, r.confidence) for r in out["joins"].collect()] == [(0, 1, "explicit")]
    assert [(r.result_idx, r.sink_idx, r.token, r.origin) for r in out["flows"].collect()] == [(1, 2, "order-99812", "read")]
    assert {r["class"] for r in out["exposures"].filter("is_verdict_grade").collect()} == {"github_token"}
    assert {r.reason for r in out["ledger"].collect()} >= {"undecodable_span", "not_genai", "unparseable", "no_spans"}
    g = out["gauge"].first()
    assert (g.calls, g.inspectable_bp, g.linkage) == (3, 10000, "explicit")


def test_calls_join_by_ids_mined_from_content(spark, tmp_path):
    def span(ref, at, **attributes):
        return {"traceId": "t", "spanId": ref, "name": "n", "kind": 1, "startTimeUnixNano": str(at), "endTimeUnixNano": str(at + 1), "attributes": [{"key": f"gen_ai.{k}", "value": {"stringValue": v}} for k, v in {"operation.name": "execute_tool", **{x.replace("_", "."): y for x, y in attributes.items()}}.items()]}

    call = lambda ref, at, token: span(ref, at, **{"tool_call_arguments": json.dumps({"tool_call_id": token})})
    result = lambda ref, at, token: span(ref, at, **{"tool_call_result": json.dumps({"tool_call_id": token})})
    spans = [call("a", 1, "one"), result("b", 3, "one"), call("c", 5, "two"), call("d", 7, "two"), result("e", 9, "two"), call("f", 11, 3), result("g", 13, 3), call("h", 15, ""), result("i", 17, "")]
    (tmp_path / "x.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]}))
    found = plans.scan(spark, tmp_path.as_uri())
    ref = {r.idx: r.node_id for r in found["nodes"].collect()}
    assert [(ref[r.call_idx], ref[r.result_idx], r.confidence) for r in found["joins"].collect()] == [("a", "b#result", "content_mined")]


def test_native_traces_are_strict(spark, tmp_path):
    node = {"id": "n", "kind": "tool_call", "timestamp": "t", "actor": "a", "source_ref": "r1", "payload": {"type": "tool_call", "tool_name": "x", "args": {"a": 1}}, "degraded": False}
    sound = {"schema_version": "1", "nodes": [node, {**node, "source_ref": "r2", "kind": "tool_result", "payload": {"type": "tool_result", "content": "c"}}], "joins": [{"tool_call_source_ref": "r1", "tool_result_source_ref": "r2", "join_confidence": "explicit"}, {"tool_call_source_ref": "r1", "tool_result_source_ref": "gone", "join_confidence": "nested"}], "metadata": {}}
    (tmp_path / "a.json").write_text(json.dumps(sound))
    (tmp_path / "b.json").write_text(json.dumps({**sound, "extra": 1}))
    rows = native.read_nodes(spark, tmp_path.as_uri()).collect()
    assert sorted((r.idx, r.kind) for r in rows if r.reason is None) == [(0, "tool_call"), (1, "tool_result")]
    assert [r.reason for r in rows if r.reason] == ["$.extra"]
    assert [(r.call_idx, r.result_idx) for r in native.read_joins(spark, tmp_path.as_uri()).collect()] == [(0, 1)]


def test_session_lines(spark, tmp_path):
    deep = "[" * 100_000
    (tmp_path / "s.jsonl").write_text(json.dumps({"message": {"content": [{"type": "tool_use", "input": {"k": "v1"}}]}}) + f"\n{deep}\n" + '{"a": "cut')
    walked = lines.walked(lines.lines(lines.files(spark, tmp_path.as_uri()))).collect()
    assert {(r.path, r.text) for r in walked if r.text == "v1"} == {("message.content[0].input.k", "v1")}
    assert {r.line: r.unread for r in walked if r.unread} in ({2: "too_deep", 3: "truncated"}, {2: "truncated", 3: "truncated"})
    placed = lines.places(spark.createDataFrame([("message.content[0].input.k",), ("message.content",), ("x",)], "path string")).collect()
    assert [r.place for r in placed] == ["tool_call", "context", "unknown"]


def test_ledger_and_verdict(spark, tmp_path):
    value, other = "correct-horse-battery/é", "another-secret-value-1"
    ledger = [{"type": "placement", "id": "p1", "kind": "env", "value": value, "required": True, "providers": []}, {"type": "placement", "id": "p2", "kind": "env", "value": other, "required": True, "providers": []}, {"type": "exercised", "placement": "p2", "evidence": "request"}]
    (tmp_path / "ledger.jsonl").write_text("\n".join(map(json.dumps, ledger)))
    (tmp_path / "capture").mkdir()
    (tmp_path / "capture" / "c.jsonl").write_text(json.dumps({"a": {"b": f"x {json.dumps(value)} y"}}) + "\n")
    out = plans.judge_capture(spark, str(tmp_path / "ledger.jsonl"), (tmp_path / "capture").as_uri())
    assert [(r.placement, r.surface.split(":")[-1]) for r in out["hits"].collect()] == [("p1", "a.b")]
    assert {(r.placement, r.state) for r in out["states"].collect()} == {("p1", "leaked"), ("p2", "exercised")}
    assert out["verdict"].first().verdict == "leak" and out["violations"].count() == 0
    bad = [*ledger, {"type": "placement", "id": "p1", "kind": "env", "value": "short", "required": True, "providers": []}, {"type": "exercised", "placement": "gone", "evidence": "request"}, {"type": "what"}, {"type": "unexpected", "id": "x", "more": 1}]
    (tmp_path / "bad.jsonl").write_text("\n".join(map(json.dumps, bad)) + '\n{"type": "flow", "type": "flow"}\n{')
    reasons = {r.reason for r in captures.violations(captures.records(spark, str(tmp_path / "bad.jsonl"))).collect()}
    assert reasons >= {"not_json", "unknown_type", "unknown_member", "repeated_id", "short_value", "dangling_placement"}


def test_needles_are_those_that_texts_contain_whatever_the_groups(spark, monkeypatch):
    from tracesift.functions.encodings import needles

    placed = [(f"p{k}", f"value-number-{k}") for k in range(4)]
    texts = [("s", 1, "a value-number-2 b"), ("s", 2, "none"), ("s", 3, "value%2Dnumber%2D3 " + b"value-number-0".hex()), ("s", 4, None)]
    strings = spark.createDataFrame(texts, "surface string, record long, text string")
    table = judge.needle_table(spark.createDataFrame(placed, "placement string, value string"))
    want = {(r, p, form) for _, r, t in texts if t for p, v in placed for n, form in needles(v) if n in t.encode()}
    for group in (judge.GROUP, 3):
        monkeypatch.setattr(judge, "GROUP", group)
        assert {(r.record, r.placement, r.form) for r in judge.find(spark, strings, table).collect()} == want
    assert want >= {(1, "p2", "raw"), (3, "p0", "hex")}


def test_requests(spark, tmp_path):
    base = {"outcome": "served", "endpoint": "e", "host": "H.example", "port": 1, "method": "GET", "path": "/p", "query": "a=1&b=x=y", "headers": [["Auth", "t"], ["Auth", "u"]], "body": "YWJj", "unread": None, "credential_fields": []}
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, [base, {**base, "body": "YW Jj"}, {**base, "odd": 1}])))
    got = captures.requests(spark, str(tmp_path / "r.jsonl"))
    assert sorted(str(r.fault) for r in got.collect()) == ["None", "bad_body", "unknown_member"]
    assert sorted((r.location, r.name, bytes(r.data)) for r in captures.request_parts(got).collect()) == [("body", "", b"abc"), ("header", "auth", b"t"), ("header", "auth", b"u"), ("path", "", b"/p"), ("query", "a", b"1"), ("query", "b", b"x=y")]


def test_environment_files(spark):
    text = "# c\nexport API_TOKEN='two\nlines'\nA=1\nB=\"x $HOME\"\ncat <<EOF\nC=no\nEOF\nset -gx FISH val\nOPEN=\"never"
    got = [(e[0], e[1], e[4], e[5], e[6]) for e in environment.entries(text)]
    assert got == [("API_TOKEN", "two\nlines", True, True, None), ("A", "1", False, True, None), ("B", "x $HOME", False, False, None), (None, None, False, False, "heredoc"), ("FISH", "val", True, True, None), ("OPEN", "never", False, True, "open_quote")]
    assert [(e[0], e[1]) for e in environment.entries("A=x\ny\0B=\0")] == [("A", "x\ny"), ("B", "")]
    files = spark.createDataFrame([("f", b"A_TOKEN=abc\nN=12\n"), ("g", b"\xff\xfe")], "path string, content binary")
    rows = environment.read(files)
    assert {(r.file, r.name, r.unread) for r in rows.collect()} == {("f", "A_TOKEN", None), ("f", "N", None), ("g", None, "undecodable")}
    assert {(r.name, r.verdict, r.why) for r in environment.judged(rows).collect()} == {("A_TOKEN", "secret", "name"), ("N", "not_secret", "number")}


def test_redaction(spark):
    placed = spark.createDataFrame([("p", "secret-value-one"), ("q", "value-one-and-more")], "placement string, value string")
    texts = spark.createDataFrame([(1, "a secret-value-one-and-more b"), (2, '{"k": ["secret-value-one", 3]}'), (3, None), (4, "clean")], "id long, text string")
    assert {r.id: r.text for r in redact.redact(spark, texts, placed).collect()} == {1: "a [p, q removed] b", 2: '{"k": ["[p removed]", 3]}', 3: None, 4: "clean"}


def test_subsumption_and_islands(spark):
    hits = spark.createDataFrame([("s", 1, "wide", 0, "x" * 20, False), ("s", 1, "inner", 5, "y" * 5, True), ("s", 2, "wide", 0, "x" * 20, False)], "surface string, record long, class string, start int, value string, eligible boolean")
    assert {(r.record, r["class"]) for r in exposure.subsumed(hits).collect()} == {(1, "inner"), (2, "wide")}
    spans = spark.createDataFrame([("a", 0, 5), ("a", 4, 9), ("a", 9, 10), ("b", 1, 2)], "k string, start long, end long")
    assert {tuple(r) for r in sessions.islands(spans, ["k"]).collect()} == {("a", 0, 9, 2), ("a", 9, 10, 1), ("b", 1, 2, 1)}


def test_fact_merge_does_not_hang_on_order(spark):
    rows = [("t", "provenance", "nested", ["b"], [3, 4]), ("t", "verbatim", "heuristic", ["a"], [1]), ("t", "provenance", "nested", ["a"], [2, 9])]
    schema = "tool string, mode string, confidence string, roles array<string>, witness array<int>"
    results = [facts.merge(spark.createDataFrame(r, schema), ["tool"]).first().asDict() for r in (rows, rows[::-1])]
    assert results[0] == results[1] == {"tool": "t", "mode": "verbatim", "roles": ["a", "b"], "confidence": "nested", "witness": [2, 9], "observations": 3}


def test_streamed_tallies_equal_the_batch(spark, tmp_path):
    rows = [(k % 5, k, "user" if k % 2 else "assistant", f"Words{'x' * (k % 7)} Abcdefgh{k % 3}") for k in range(60)]
    schema = "conv_id long, turn long, role string, text string"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_sessions.tally(stream_sessions.read(spark, str(tmp_path / "in"), schema), "[A-Z][a-z]{6,}")
    query = stream.writeStream.outputMode("update").format("memory").queryName("tallies").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {}
    for r in spark.table("tallies").collect():
        if r.conv_id not in got or r.messages > got[r.conv_id][0]:
            got[r.conv_id] = (r.messages, r.prompts, r.chars, r.values_seen)
    batch = sessions.tallies(spark.createDataFrame(rows, schema), "[A-Z][a-z]{6,}").collect()
    assert got == {r.conv_id: (r.messages, r.prompts, r.chars, r.values_seen) for r in batch}


@pytest.mark.parametrize("records,want", [([("call", "t", "1"), ("result", "t", "1"), ("result", "t", "1"), ("result", "u", "9")], ["executed", "retry", "unmediated"]), ([("call", "t", "1"), ("result", "t", "2")], ["mismatch"])])
def test_tool_ledger(spark, records, want):
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(records)], "flow long, seq long, kind string, tool string, call string")
    assert [r.verdict for r in tool_ledger.batch(df).orderBy("seq").collect()] == want


def test_a_large_ledger_and_all_views_take_one_pass(spark):
    placed = [(f"p{k}", f"value-{k:05d}") for k in range(4000)]
    table = judge.needle_table(spark.createDataFrame(placed, "placement string, value string"))
    strings = spark.createDataFrame([("s", 1, "value-00017 and value-03999"), ("s", 2, r'["value\u002d00003"]')], "surface string, record long, text string")
    assert table.count() > 20_000
    found, _ = judge.find_viewed(spark, strings, table)
    assert found._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    assert {(r.record, r.placement, r.form) for r in found.collect()} == {(1, "p17", "raw"), (1, "p3999", "raw"), (2, "p3", "json")}


def test_views_hold_what_a_search_of_whole_views_finds(spark):
    import random

    from tracesift.functions.encodings import needles, views

    rng, alphabet = random.Random(5), 'ab"\\/\n-'
    placed = [(f"p{k}", "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 24)))) for k in range(30)]
    texts = []
    for k in range(300):
        t = "".join(rng.choice([*alphabet, rng.choice(placed)[1]]) for _ in range(rng.randint(0, 30)))
        for _ in range(rng.randint(0, 4)):
            t = json.dumps([t], ensure_ascii=rng.random() < 0.5)
        texts.append(("s", k, t if rng.random() < 0.7 else f"x {t} y\\u0022"))
    want = {}
    for _, k, t in texts:
        whole = t.encode()
        for level, data in [(0, whole), *((n, v) for part in judge.json_inside(whole) for n, v in enumerate(views(part)[0], 1))]:
            for p, v in placed:
                forms = [judge.FORMS.index(form) for n, form in needles(v) if n in data]
                if forms:
                    want[k, p] = min(want.get((k, p), (99, 99)), (level, min(forms)))
    strings = spark.createDataFrame(texts, "surface string, record long, text string")
    found = judge.find(spark, strings.withColumn("undo", F.lit(True)), judge.needle_table(spark.createDataFrame(placed, "placement string, value string")))
    got = {}
    for r in found.collect():
        got[r.record, r.placement] = min(got.get((r.record, r.placement), (99, 99)), (r.level, r.rank))
    assert got == want and {level for level, _ in want.values()} >= {0, 1, 2}
