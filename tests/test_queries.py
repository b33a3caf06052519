"""Every query with SQL returns the SQL's rows; the others run and keep their promises."""

import os
from pathlib import Path

import pytest

from tracesift import analyses, queries

QUERIES, ORACLES = queries.QUERIES | analyses.QUERIES, queries.ORACLE_SQL | analyses.ORACLE_SQL
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")

    def run(sql):
        con = duckdb.connect()
        for f in Path(SF).glob("*.parquet"):
            con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        return con.sql(sql).df()

    return run


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    whole = lambda x: str(int(x)) if isinstance(x, float) and x == int(x) else str(x)  # noqa: E731 (numbers beside nulls come as floats)
    text = lambda df: df[columns].astype(object).where(df[columns].notna(), None).map(whole).sort_values(columns).reset_index(drop=True)
    assert text(got).equals(text(want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_joins_of_random_traces_are_those_of_call_order(spark):
    """Sets where no order decides and Python elsewhere give what Python gives everywhere."""
    import random

    from tracesift.operators import trace

    rng, rows = random.Random(4), []
    for t in range(80):
        ids = [f"c{k}" for k in range(4)] + [None, ""]
        spans = []
        for k in range(rng.randint(1, 10)):
            call = rng.random() < 0.5
            parent = rng.choice(spans) if spans and rng.random() < 0.6 else None
            spans.append(f"s{k}")
            mined = rng.choice(["m1", "m2"]) if t % 4 == 0 and rng.random() < 0.4 else None
            rows.append((t, k, f"s{k}", "tool_call" if call else "tool_result", rng.choice(ids), None if call else parent, mined))
    nodes = spark.createDataFrame(rows, "trace_id long, idx int, node_id string, kind string, call_id string, parent_id string, mined_id string")
    got = sorted((tuple(r) for r in trace.resolve(nodes).collect()), key=str)
    assert got == sorted((tuple(r) for r in trace.resolve_exactly(nodes).collect()), key=str)
    assert {r[3] for r in got} >= {"explicit", "nested", "content_mined", "ambiguous_join", "shared_call_id"}
    left = trace.contested(nodes).count()
    assert 0 < left < 80


def test_reachability_equals_a_plain_search(spark):
    import random

    from tracesift.operators.taint import reachable

    rng, nodes, joins = random.Random(8), [], []
    for t in range(40):
        n = rng.randint(1, 9)
        nodes += [(t, k) for k in range(n)]
        joins += [(t, rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 5))]
    got = {(r.trace_id, r.idx): r.lo for r in reachable(spark.createDataFrame(nodes, "trace_id long, idx int"), spark.createDataFrame(joins, "trace_id long, call_idx int, result_idx int")).collect()}
    for t, start in nodes:
        last = max(k for x, k in nodes if x == t)
        seen, todo = set(), [start]
        while todo:
            at = todo.pop()
            for to in [*([at + 1] if at < last else []), *(r for x, c, r in joins if x == t and c == at)]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        assert set(range(got[(t, start)], last + 1)) == seen
