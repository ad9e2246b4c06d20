import duckdb
import pytest

import __spark_entry__
from lumenweave.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(format(v, ".9g") if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in ("distribution_cables", "cto_order")])
def test_against_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_part_table(spark):
    from collections import Counter
    from math import asin, cos, radians, sin, sqrt

    keys = [r.p_partkey for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()]
    nodes = {(k // 121, k % 11, k % 121 // 11) for k in keys}
    edges = [(p, i, j, a, b) for p, i, j in nodes for a, b in ((i + 1, j), (i, j + 1)) if (p, a, b) in nodes]
    got = {r.project_id: (r.edges, r.nodes) for r in QUERIES["whole_street_edges"](spark, SF).collect()}
    assert got == {p: (sum(e[0] == p for e in edges), sum(n[0] == p for n in nodes)) for p in {n[0] for n in nodes}} and len(got) > 1
    sides = Counter((p, i <= 4) for p, i, _ in nodes)
    assert sorted((r.project_id, r["size"]) for r in QUERIES["whole_street_components"](spark, SF).collect()) == sorted((p, n) for (p, _), n in sides.items())
    got = {(r.project_id, r.status == "OK"): r.n for r in QUERIES["whole_route_status"](spark, SF).collect()}
    assert got == dict(sides)
    at = {k: (-44.3 + (k % 200 % 14) * 4e-4 + (k % 200 * 37 % 11) * 1e-5, -2.5 + (k % 200 // 14) * 4e-4 + (k % 200 * 53 % 13) * 1e-5) for k in keys}

    def metres(p, q):
        (x, y), (u, v) = p, q
        h = sin(radians(v - y) / 2) ** 2 + cos(radians(y)) * cos(radians(v)) * sin(radians(u - x) / 2) ** 2
        return 2 * 6371000 * asin(sqrt(h))

    want = {(a, b) for a in at for b in at if a < b and a // 200 == b // 200 and metres(at[a], at[b]) <= 60}
    assert {(r.a, r.b) for r in QUERIES["whole_pole_spans"](spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["whole_pole_crossings", "whole_pole_spans", "whole_snap_limit"])
def test_joins_of_large_tables_send_nothing_through_the_driver(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan
