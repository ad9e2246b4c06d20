import itertools

import numpy as np
import pandas as pd
import pytest

from lumenweave.operators import graph
from lumenweave.plans.config import DEFAULT

V = "project_id long, way_id long, seq int, lon double, lat double"
R = "project_id long, req_id long, o_lon double, o_lat double, d_lon double, d_lat double, kind string"


def test_statuses(spark):
    v = [(1, 1, i, i * 0.001, 0.0) for i in range(3)] + [(2, 1, 0, 0.0, 0.0), (2, 1, 1, 0.001, 0.0), (2, 2, 0, 0.01, 0.0), (2, 2, 1, 0.011, 0.0), (3, 1, 0, 0.0, -0.001), (3, 1, 1, 0.0, 0.001)]
    edges = graph.street_edges(spark.createDataFrame(v, V))
    req = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.002, 0.0, "distribuicao"), (2, 1, 0.0, 0.0, 0.01, 0.0, "x"), (3, 1, 0.001, 0.0, 0.0, 0.001, "x"), (4, 1, 0.0, 0.0, 1.0, 1.0, "x")], R)
    got = {r.project_id: r for r in graph.routes(req, edges, DEFAULT, 50.0).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "OK", 2: "SEM_CAMINHO", 3: "FORA_DA_MALHA", 4: "SEM_MALHA"}
    assert got[1].dist_m == pytest.approx(229.06) and len(got[1].path) == 3
    assert all(r.dist_m == 0 and not r.path and r.message for k, r in got.items() if k != 1)
    assert got[4].snap_o_m is None and got[3].snap_o_m == pytest.approx(157.25, abs=0.1)


def test_partitions_do_not_matter(spark):
    v = [(1, i, s, 0.001 * (i % 5 + s), 0.001 * (i // 5)) for i in range(20) for s in (0, 1)] + [(1, 100 + i, s, 0.001 * (i % 6), 0.001 * (i // 6 + s)) for i in range(18) for s in (0, 1)]
    req = spark.createDataFrame([(1, i, 0.0, 0.0, 0.001 * (i % 6), 0.001 * (i // 6), "cto") for i in range(24)], R)
    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        edges = graph.street_edges(spark.createDataFrame(v, V).repartition(int(n)))
        out.append(sorted((r.req_id, r.status, r.dist_m, len(r.path)) for r in graph.routes(req, edges, DEFAULT).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_tree_and_ring():
    rng = np.random.default_rng(2)
    for n in (2, 3, 5, 7):
        p = rng.random((n, 2))
        w = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        tree = graph.spanning_tree(n, [(w[i, j], i, j) for i, j in itertools.combinations(range(n), 2)])
        cost = sum(w[a, b] for a, b in tree)
        tour = graph.ring_tour(w)
        length = sum(w[a, b] for a, b in itertools.pairwise(tour))
        assert len(tree) == n - 1 and tour[0] == tour[-1] and set(tour) == set(range(n))
        assert length <= 2 * cost + 1e-9
        if n <= 7:
            best = min(sum(w[a, b] for a, b in itertools.pairwise((0, *q, 0))) for q in itertools.permutations(range(1, n)))
            assert length <= 1.5 * best


def test_two_node_ring_has_two_legs(spark):
    rows = graph.backbone_edges(spark.createDataFrame([(1, 3, 9, 5.0)], "project_id long, a int, b int, weight double"), "anel").collect()
    assert [(r.leg_no, r.a, r.b) for r in rows] == [(1, 3, 9), (2, 3, 9)]


def test_poles_replace_streets(spark):
    e = "project_id long, x1 double, y1 double, x2 double, y2 double, weight double, real_dist double"
    streets = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0)], e)
    poles = spark.createDataFrame([(1, 5.0, 5.0, 6.0, 5.0, 3.0, 1.0)], e)
    assert sorted((r.project_id, r.x1) for r in graph.graph_of(streets, poles).collect()) == [(1, 5.0), (2, 0.0)]


def test_searches_equal_whole_ones():
    rng = np.random.default_rng(4)
    p = np.round(rng.random((400, 2)) * np.array([20, 20])) / 10  # many ties
    pairs = [(i, (i + s) % 400) for i in range(400) for s in (1, 7) if (i // 100) == ((i + s) % 400) // 100]
    edges = pd.DataFrame([(*p[i], *p[j], 1 + (i * j) % 5) for i, j in pairs if tuple(p[i]) != tuple(p[j])], columns=["x1", "y1", "x2", "y2", "weight"])
    net = graph.Net(edges)
    for q in rng.random((200, 2)) * 4 - 1:
        d = ((net.nodes - q) ** 2).sum(axis=1)
        assert net.nearest(tuple(q))[0] == tuple(net.nodes[int(np.argmin(d))])
    nodes = [tuple(map(float, n)) for n in net.nodes]
    for a in nodes[::40]:
        dist, changed = {a: 0.0}, True
        while changed:
            changed = False
            for u in list(dist):
                for v, w in net.near[u].items():
                    if dist[u] + w < dist.get(v, np.inf):
                        dist[v], changed = dist[u] + w, True
        for b in nodes[::7]:
            before = net.before(a, b)
            assert (before is not None) == (b in dist)
            if before:
                total, at = 0.0, b
                while at != a:
                    total, at = total + net.near[before[at]][at], before[at]
                assert total == dist[b]


def test_projects_go_to_tasks_of_their_own(spark):
    ask = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 0.0, "cto")], "project_id long, req_id long, o_lon double, o_lat double, d_lon double, d_lat double, kind string")
    edges = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0)], graph.EDGE)
    pairs = spark.createDataFrame([(1, 0, 1, 1.0)], "project_id long, a int, b int, weight double")
    for df in (graph.routes(ask, edges, DEFAULT), graph.backbone_edges(pairs, "anel")):
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
