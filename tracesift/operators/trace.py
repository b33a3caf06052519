"""Which call produced which result.

Tiers: an explicit call id, then nesting, then an id mined from content. An id that several calls share is no
evidence for any of them; a call that matches several results nobody claimed yet is ambiguous in that tier and
tries the next; a claimed result is gone for later calls. Where a call was joined and its mined id is also another
result's, the join stays and the conflict is named. `resolve` does this exactly, a trace at a time and in
call order; `resolve_sets` gives the same by joins alone, for traces where no result is wanted by two calls.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_trace(nodes: list[dict]) -> tuple[list[tuple], list[tuple]]:
    """(call idx, result idx, confidence) and (reason, call idx) for one trace's nodes in order."""
    calls = [n for n in nodes if n["kind"] == "tool_call"]
    results = [n for n in nodes if n["kind"] == "tool_result"]
    owners = Counter(n["call_id"] for n in calls if n["call_id"])
    claimed: set[int] = set()
    joins: list[tuple] = []
    ledger = [("shared_call_id", next(n["idx"] for n in calls if n["call_id"] == c)) for c, k in owners.items() if k > 1]
    miners = Counter(n["mined_id"] for n in calls if n.get("mined_id"))
    ledger += [("shared_mined_id", next(n["idx"] for n in calls if n.get("mined_id") == c)) for c, k in miners.items() if k > 1]
    by_id: dict[str, list[int]] = {}
    by_parent: dict[object, list[int]] = {}
    mined: dict[str, list[int]] = {}
    for r in results:
        for index, key in ((by_id, r["call_id"]), (by_parent, r["parent_id"]), (mined, r.get("mined_id"))):
            if key:
                index.setdefault(key, []).append(r["idx"])
    done: set[int] = set()

    def claim(call: dict, wanted: list[int], confidence: str) -> bool:
        free = [i for i in wanted if i not in claimed]
        if len(free) > 1:
            ledger.append(("ambiguous_join", call["idx"]))
        if len(free) != 1:
            return False
        claimed.add(free[0])
        done.add(call["idx"])
        joins.append((call["idx"], free[0], confidence))
        return True

    for call in calls:
        single = call["call_id"] and owners[call["call_id"]] == 1
        if not (single and claim(call, by_id.get(call["call_id"], []), "explicit")):
            claim(call, by_parent.get(call["node_id"], []), "nested")
    of = {c: r for c, r, _ in joins}
    for call in calls:
        if call.get("mined_id") and miners[call["mined_id"]] == 1:
            wanted = mined.get(call["mined_id"], [])
            if call["idx"] not in done:
                claim(call, wanted, "content_mined")
            elif any(r != of[call["idx"]] for r in wanted):
                ledger.append(("conflicting_join_evidence", call["idx"]))
    return joins, ledger


_COLUMNS = ["trace_id", "idx", "node_id", "kind", "call_id", "parent_id", "mined_id"]
_JOINED = "trace_id long, call_idx int, result_idx int, confidence string"


def contested(nodes: DataFrame) -> DataFrame:
    """trace_id of traces where the order of calls decides: a result that two calls may claim, or ids mined from content."""
    calls = nodes.filter("kind = 'tool_call'")
    results = nodes.filter("kind = 'tool_result'")
    owner = calls.filter("call_id <> ''").groupBy("trace_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("owner")).filter("n = 1")
    parent = calls.select("trace_id", F.col("node_id").alias("parent_id")).distinct()
    wanted = results.join(owner, ["trace_id", "call_id"]).join(parent, ["trace_id", "parent_id"]).filter("owner <> parent_id").select("trace_id")
    return wanted.unionByName(nodes.filter("mined_id IS NOT NULL").select("trace_id")).distinct()


def resolve_exactly(nodes: DataFrame) -> DataFrame:
    """In call order, a trace at a time."""

    def one(pdf):
        import pandas as pd

        ordered = pdf.sort_values("idx").astype(object)
        joins, ledger = resolve_trace(ordered.where(ordered.notna(), None).to_dict("records"))
        trace = pdf["trace_id"].iloc[0]
        return pd.DataFrame([(trace, c, r, x) for c, r, x in joins] + [(trace, c, None, x) for x, c in ledger], columns=["trace_id", "call_idx", "result_idx", "confidence"]).astype({"call_idx": "Int32", "result_idx": "Int32"})

    return nodes.select(*_COLUMNS).groupBy("trace_id").applyInPandas(one, _JOINED)


def resolve(nodes: DataFrame) -> DataFrame:
    """trace_id, call_idx, result_idx, confidence; and rows with a null result for the ledger's reasons.

    Traces that no order decides are joined as sets; Python sees only the others.
    """
    # columns of its own, as the nodes are joined to what is derived from them
    open_ = contested(nodes).select((F.col("trace_id") + 0).alias("trace_id"))
    plain = nodes.join(open_, "trace_id", "left_anti")
    return resolve_sets(plain, ledger=True).unionByName(resolve_exactly(nodes.join(open_, "trace_id", "left_semi")))


def resolve_sets(nodes: DataFrame, ledger: bool = False) -> DataFrame:
    """Explicit and nested joins by sets: ids with one call and one result, then only children nobody claimed.

    With `ledger` also rows without a result that name ids shared by calls and calls with several results.
    """
    calls = nodes.filter("kind = 'tool_call'").select("trace_id", F.col("idx").alias("call_idx"), "node_id", "call_id")
    results = nodes.filter("kind = 'tool_result'").select("trace_id", F.col("idx").alias("result_idx"), "call_id", "parent_id")
    n = F.count(F.lit(1)).alias("n")
    named = calls.filter("call_id <> ''").groupBy("trace_id", "call_id").agg(n, F.min("call_idx").alias("call_idx"))
    given = results.filter("call_id <> ''").groupBy("trace_id", "call_id").agg(F.count(F.lit(1)).alias("k"), F.min("result_idx").alias("result_idx"))
    met = named.filter("n = 1").join(given, ["trace_id", "call_id"])
    explicit = met.filter("k = 1").select("trace_id", "call_idx", "result_idx", F.lit("explicit").alias("confidence"))
    free = results.join(explicit.select("trace_id", "result_idx"), ["trace_id", "result_idx"], "left_anti")
    rest = calls.join(explicit.select("trace_id", "call_idx"), ["trace_id", "call_idx"], "left_anti")
    inside = rest.join(free.select("trace_id", "result_idx", F.col("parent_id").alias("node_id")), ["trace_id", "node_id"])
    inside = inside.groupBy("trace_id", "call_idx").agg(n, F.min("result_idx").alias("result_idx"))
    joins = explicit.unionByName(inside.filter("n = 1").select("trace_id", "call_idx", "result_idx", F.lit("nested").alias("confidence")))
    if not ledger:
        return joins
    row = lambda found, reason: found.select("trace_id", "call_idx", F.lit(None).cast("int").alias("result_idx"), F.lit(reason).alias("confidence"))
    return joins.unionByName(row(named.filter("n > 1"), "shared_call_id")).unionByName(row(met.filter("k > 1"), "ambiguous_join")).unionByName(row(inside.filter("n > 1"), "ambiguous_join"))


#: The exact joins in SQL, call by call: view `exact` with the ledger's rows, and `joins` without them.
EXACT_SQL = """
calls AS (SELECT trace_id, idx AS call_idx, node_id, call_id, row_number() OVER (PARTITION BY trace_id ORDER BY idx) AS k, count(*) OVER (PARTITION BY trace_id, call_id) AS owners FROM nodes WHERE kind = 'tool_call'),
results AS (SELECT trace_id, idx AS result_idx, call_id, parent_id FROM nodes WHERE kind = 'tool_result'),
by_id AS (SELECT trace_id, call_id, list(result_idx) AS ids FROM results WHERE call_id <> '' GROUP BY ALL),
by_parent AS (SELECT trace_id, parent_id AS node_id, list(result_idx) AS children FROM results WHERE parent_id IS NOT NULL GROUP BY ALL),
wanted AS (SELECT c.*, CASE WHEN owners = 1 AND c.call_id <> '' THEN coalesce(ids, []) ELSE [] END AS ids, coalesce(children, []) AS children
  FROM calls c LEFT JOIN by_id USING (trace_id, call_id) LEFT JOIN by_parent USING (trace_id, node_id)),
claiming AS (SELECT trace_id, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS claimed, CAST(NULL AS INTEGER) AS call_idx, CAST(NULL AS INTEGER) AS result_idx, CAST(NULL AS VARCHAR) AS confidence, 0 AS ambiguous FROM calls GROUP BY trace_id
  UNION ALL SELECT trace_id, k, CASE WHEN result IS NULL THEN claimed ELSE list_append(claimed, result) END, call_idx, result, confidence, ambiguous FROM (
    SELECT trace_id, k, claimed, call_idx, CASE WHEN len(e) = 1 THEN e[1] WHEN len(c) = 1 THEN c[1] END AS result,
      CASE WHEN len(e) = 1 THEN 'explicit' WHEN len(c) = 1 THEN 'nested' END AS confidence, CASE WHEN len(e) > 1 THEN 1 ELSE 0 END + CASE WHEN len(e) <> 1 AND len(c) > 1 THEN 1 ELSE 0 END AS ambiguous FROM (
      SELECT w.trace_id, w.k, a.claimed, w.call_idx, list_filter(w.ids, lambda x: NOT list_contains(a.claimed, x)) AS e, list_filter(w.children, lambda x: NOT list_contains(a.claimed, x)) AS c
      FROM claiming a JOIN wanted w ON w.trace_id = a.trace_id AND w.k = a.k + 1))),
joins AS MATERIALIZED (SELECT trace_id, call_idx, result_idx, confidence FROM claiming WHERE result_idx IS NOT NULL),
exact AS (SELECT * FROM joins UNION ALL SELECT trace_id, call_idx, NULL, 'ambiguous_join' FROM (SELECT trace_id, call_idx, unnest(range(0, ambiguous)) FROM claiming)
  UNION ALL SELECT trace_id, min(call_idx), NULL, 'shared_call_id' FROM calls WHERE owners > 1 AND call_id <> '' GROUP BY trace_id, call_id)"""


JOINS_SQL = """
calls AS (SELECT trace_id, idx AS call_idx, node_id, call_id FROM nodes WHERE kind = 'tool_call'),
results AS (SELECT trace_id, idx AS result_idx, call_id, parent_id FROM nodes WHERE kind = 'tool_result'),
explicit AS (SELECT trace_id, call_idx, result_idx, 'explicit' AS confidence FROM
  (SELECT trace_id, call_id, min(call_idx) AS call_idx FROM calls GROUP BY ALL HAVING count(*) = 1) JOIN
  (SELECT trace_id, call_id, min(result_idx) AS result_idx FROM results GROUP BY ALL HAVING count(*) = 1) USING (trace_id, call_id)),
nested AS (SELECT trace_id, call_idx, min(result_idx) AS result_idx, 'nested' AS confidence FROM
  (SELECT * FROM calls WHERE (trace_id, call_idx) NOT IN (SELECT trace_id, call_idx FROM explicit)) c JOIN
  (SELECT trace_id, result_idx, parent_id AS node_id FROM results WHERE (trace_id, result_idx) NOT IN (SELECT trace_id, result_idx FROM explicit)) r USING (trace_id, node_id)
  GROUP BY trace_id, call_idx HAVING count(*) = 1),
joins AS (SELECT * FROM explicit UNION ALL SELECT * FROM nested)"""


def gauge(nodes: DataFrame, joins: DataFrame) -> DataFrame:
    """Coverage of each trace in basis points: arguments captured, degraded calls, tiers of joins, fit for a verdict."""
    calls = nodes.filter("kind = 'tool_call'").join(joins.select("trace_id", F.col("call_idx").alias("idx"), "confidence"), ["trace_id", "idx"], "left")
    bp = lambda part, whole: F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.floor(part * 10000 / whole))
    captured = F.col("args").isNotNull()
    fit = captured & ~F.col("degraded") & F.coalesce(F.col("confidence").isin("explicit", "nested"), F.lit(False))
    n, joined = F.count(F.lit(1)), F.count("confidence")
    return calls.groupBy("trace_id").agg(
        n.alias("calls"), bp(F.count_if(captured), n).alias("inspectable_bp"), bp(F.count_if("degraded"), n).alias("degraded_bp"),
        bp(F.count_if(F.col("confidence") == "explicit"), joined).alias("explicit_bp"), bp(F.count_if(F.col("confidence") == "nested"), joined).alias("nested_bp"),
        bp(F.count_if(fit), n).alias("eligible_bp"),
    )


def ladder(report: DataFrame) -> DataFrame:
    """What the telemetry allows: how calls are linked, and whether cross-step analysis is possible."""
    linkage = F.when(F.col("explicit_bp") == 10000, "explicit").when(F.col("explicit_bp") + F.col("nested_bp") == 10000, "structural").otherwise("absent")
    return report.withColumns({"linkage": linkage, "taint_capable": F.col("inspectable_bp") > 0})
