"""Native traces, strictly: an unknown member rejects the document, with its path as the reason."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: Fixed: members of each level of the format.
TOP = {"schema_version", "nodes", "joins", "metadata"}
NODE = {"id", "kind", "timestamp", "actor", "source_ref", "payload", "degraded"}
PAYLOAD = {"tool_call": {"type", "tool_name", "args"}, "tool_result": {"type", "content"}, "llm_call": {"type", "content"}, "user_input": {"type", "content"}}
JOIN = {"tool_call_source_ref", "tool_result_source_ref", "join_confidence", "join_source"}
CONFIDENCES = ("explicit", "nested", "content_mined", "heuristic")
_NODES = "file string, trace_id string, idx int, node_id string, kind string, at string, source_ref string, degraded boolean, tool_name string, args string, content string, reason string"
_JOINS = "file string, call_idx int, result_idx int, confidence string"


def faults(value: object) -> list[str]:
    """Paths of what the format does not allow."""
    if not isinstance(value, dict):
        return ["$"]
    out = [f"$.{k}" for k in value.keys() - TOP]
    if not isinstance(value.get("nodes"), list):
        return [*out, "$.nodes"]
    for k, n in enumerate(value["nodes"]):
        if not isinstance(n, dict):
            out.append(f"$.nodes[{k}]")
            continue
        out += [f"$.nodes[{k}].{x}" for x in n.keys() - NODE]
        payload = n.get("payload")
        allowed = PAYLOAD.get(payload.get("type")) if isinstance(payload, dict) else None
        out += [f"$.nodes[{k}].payload"] if allowed is None else [f"$.nodes[{k}].payload.{x}" for x in payload.keys() - allowed]
    for k, j in enumerate(value.get("joins") or []):
        if not isinstance(j, dict) or j.get("join_confidence") not in CONFIDENCES:
            out.append(f"$.joins[{k}]")
        else:
            out += [f"$.joins[{k}].{x}" for x in j.keys() - JOIN]
    return sorted(out)


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def read_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each node in its document's order; a rejected document is one row with the reason."""

    def decode(batches):
        import pandas as pd
        import pyarrow as pa

        from tracesift.walk import parsed

        for batch in batches:
            out = []
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                value, why = parsed(content.as_py())
                bad = [why] if why else faults(value)
                if bad:
                    out.append((file, *[None] * 10, bad[0]))
                    continue
                for k, n in enumerate(value["nodes"]):
                    p = n["payload"]
                    out.append((file, file, k, n.get("id"), n.get("kind") or p["type"], n.get("timestamp"), n.get("source_ref"), bool(n.get("degraded")), p.get("tool_name"), json.dumps(p["args"]) if p.get("args") else None, p.get("content"), None))
            columns = [c.split()[0] for c in _NODES.split(", ")]
            yield from pa.Table.from_pandas(pd.DataFrame(out, columns=columns), schema=pa.schema([(c, {"int": pa.int32(), "boolean": pa.bool_()}.get(t, pa.string())) for c, t in (x.split() for x in _NODES.split(", "))]), preserve_index=False).to_batches()

    return _read(spark, folder).mapInArrow(decode, _NODES)


def read_joins(spark: SparkSession, folder: str) -> DataFrame:
    """Join records to node positions; of nodes that share a source_ref the last counts, dangling ones are left out."""

    def decode(batches):
        import pyarrow as pa

        from tracesift.walk import parsed

        for batch in batches:
            out = []
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                value, why = parsed(content.as_py())
                if why or faults(value):
                    continue
                at = {n.get("source_ref"): k for k, n in enumerate(value["nodes"])}
                for j in value.get("joins") or []:
                    call, result = at.get(j.get("tool_call_source_ref")), at.get(j.get("tool_result_source_ref"))
                    if call is not None and result is not None:
                        out.append((file, call, result, j["join_confidence"]))
            types = [pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["file", "call_idx", "result_idx", "confidence"])

    return _read(spark, folder).mapInArrow(decode, _JOINS)
