"""Street and pole graphs: edges, routes with explicit failures, components, spanning trees and rings.

A node is an exact pair of coordinates.  Routes of one project run in one task from an adjacency list, one
search for each origin; ``shortest_distances`` is the relational form for graphs beyond a task's memory.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import dealt, written

OK, NO_MESH, OFF_MESH, NO_PATH = "OK", "SEM_MALHA", "FORA_DA_MALHA", "SEM_CAMINHO"
# The messages of failed routes.
MESSAGES = {
    OK: "",
    NO_MESH: "malha viária/física indisponível",
    OFF_MESH: "origem ou destino excede a distância máxima de conexão à malha",
    NO_PATH: "não existe caminho físico entre origem e destino",
}
EDGE = "project_id long, x1 double, y1 double, x2 double, y2 double, weight double, real_dist double"


def street_edges(vertices: DataFrame) -> DataFrame:
    """Undirected edges between consecutive vertices of ways; equal pairs once, without zero-length ones."""
    by = Window.partitionBy("project_id", "way_id").orderBy("seq")
    at = F.struct(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    rows = vertices.select("project_id", at.alias("p"), F.lead(at).over(by).alias("q")).filter("q is not null and p <> q")
    rows = rows.select("project_id", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    metres = geo.haversine("p.lon", "p.lat", "q.lon", "q.lat")
    return rows.select("project_id", F.col("p.lon").alias("x1"), F.col("p.lat").alias("y1"), F.col("q.lon").alias("x2"), F.col("q.lat").alias("y2"), metres.alias("weight"), metres.alias("real_dist"))


def graph_of(streets: DataFrame | None, poles: DataFrame | None) -> DataFrame:
    """The graph to route on: where a project has spans of poles these replace its street edges.

    ``poles``: weighted spans from ``crossing_penalty`` (a project without poles has none there).
    """
    cols = [c.split()[0] for c in EDGE.split(", ")]
    if poles is None:
        return streets.select(*cols)
    if streets is None:
        return poles.select(*cols)
    return streets.join(poles.select("project_id").distinct(), "project_id", "left_anti").select(*cols).unionByName(poles.select(*cols))


def node_table(edges: DataFrame) -> DataFrame:
    """Distinct nodes, numbered by a hash of their coordinates' bits: project_id, node_id, lon, lat."""
    ends = edges.select("project_id", F.inline(F.array(F.struct(F.col("x1").alias("lon"), F.col("y1").alias("lat")), F.struct(F.col("x2").alias("lon"), F.col("y2").alias("lat"))))).distinct()
    return ends.withColumn("node_id", F.xxhash64("lon", "lat"))


class Net:
    """Adjacency list of one project's graph."""

    def __init__(self, edges: pd.DataFrame):
        self.near: dict[tuple, dict] = defaultdict(dict)
        for x1, y1, x2, y2, w in zip(*(edges[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2", "weight")), strict=True):
            a, b = (x1, y1), (x2, y2)
            self.near[a][b] = self.near[b][a] = w
        self.nodes = np.array(sorted(self.near), float).reshape(-1, 2)
        self.trees: dict[tuple, tuple] = {}

    def nearest(self, p: tuple[float, float]) -> tuple[tuple[float, float], float]:
        """The nearest node in planar degrees (the first of equals) and its metres, from a window of the nodes by longitude."""
        x, at, width = self.nodes[:, 0], np.array(p), 64
        mid = int(np.searchsorted(x, p[0]))
        while True:
            lo, hi = max(mid - width, 0), min(mid + width, len(x))
            d = ((self.nodes[lo:hi] - at) ** 2).sum(axis=1)
            i = int(np.argmin(d))
            if (lo == 0 or (x[lo] - p[0]) ** 2 > d[i]) and (hi == len(x) or (x[hi - 1] - p[0]) ** 2 > d[i]):
                node = (float(self.nodes[lo + i, 0]), float(self.nodes[lo + i, 1]))
                return node, metres(p, node)
            width *= 4

    def before(self, source: tuple, target: tuple) -> dict | None:
        """Predecessors on least ways from ``source``, searched as far as ``target``; None if there is no way.

        The search is kept: the next target of the same source goes on where it stopped.
        """
        if source not in self.trees:
            if len(self.trees) > 64:
                self.trees.clear()
            self.trees[source] = ({source: 0.0}, {source: source}, [(0.0, source)], set())
        dist, before, heap, done = self.trees[source]
        while heap and target not in done:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            for v, w in self.near[u].items():
                if d + w < dist.get(v, np.inf):
                    dist[v], before[v] = d + w, u
                    heapq.heappush(heap, (d + w, v))
        return before if target in done else None


def metres(a, b) -> float:
    lon1, lat1, lon2, lat2 = np.radians([a[0], a[1], b[0], b[1]])
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return float(2 * geo.EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(1 - h)))


ROUTE = "project_id long, req_id long, status string, lons array<double>, lats array<double>, snap_o_m double, snap_d_m double"


def routes(requests: DataFrame, edges: DataFrame, config: dict, limit_m: Column | float | None = None) -> DataFrame:
    """Routes of requests (project_id, req_id, o_lon, o_lat, d_lon, d_lat, kind).

    Status in this order: no mesh, an access leg over the limit, no path, OK.  A path runs from the origin over
    graph nodes to the destination without repeated points; ``dist_m`` is its length, access legs included,
    with sag and the kind's reserve.  A failed route has an empty path and length 0, never a straight line.
    """
    lim = limit_m if isinstance(limit_m, Column) else F.lit(None if limit_m is None else float(limit_m)).cast("double")
    asked = requests.select("project_id", "req_id", "o_lon", "o_lat", "d_lon", "d_lat", lim.alias("lim"))

    def run(key, req: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        net, out, ends = Net(edge), [], {}

        def end(p: tuple[float, float]) -> tuple[tuple[float, float], float]:
            if p not in ends:
                ends[p] = net.nearest(p)
            return ends[p]

        req, project, some = req.sort_values(["o_lon", "o_lat", "req_id"]), key[0], len(net.nodes) > 0
        for req_id, o_lon, o_lat, d_lon, d_lat, most in zip(*(req[c].tolist() for c in ("req_id", "o_lon", "o_lat", "d_lon", "d_lat", "lim")), strict=True):
            o, d = (o_lon, o_lat), (d_lon, d_lat)
            if not some:
                out.append((project, req_id, NO_MESH, [], [], None, None))
                continue
            (a, da), (b, db) = end(o), end(d)
            if pd.notna(most) and (da > most or db > most):
                out.append((project, req_id, OFF_MESH, [], [], da, db))
                continue
            before = net.before(a, b)
            if before is None:
                out.append((project, req_id, NO_PATH, [], [], da, db))
                continue
            back = [b]
            while back[-1] != a:
                back.append(before[back[-1]])
            way = (o, *reversed(back), d)
            out.append((project, req_id, OK, [x for x, _ in way], [y for _, y in way], da, db))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ROUTE.split(", ")])

    found = dealt(asked, "project_id").groupBy("project_id").cogroup(dealt(edges, "project_id").groupBy("project_id")).applyInPandas(run, ROUTE)
    path = F.zip_with("lons", "lats", lambda x, y: F.struct(x.alias("lon"), y.alias("lat")))
    found = found.withColumn("path", geo.without_repeats(path)).drop("lons", "lats").withColumn("plain_m", geo.path_metres("path"))
    note = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    return (
        requests.join(found, ["project_id", "req_id"])
        .withColumn("dist_m", F.when(F.col("status") == OK, geo.with_reserve("plain_m", F.col("kind"), config)).otherwise(F.lit(0.0)))
        .withColumn("message", F.element_at(note, F.col("status")))
    )


def shortest_distances(edges: DataFrame, sources: DataFrame, every: int = 3) -> DataFrame:
    """Least weight from each project's source nodes (project_id, x, y) to all nodes they reach, by relaxation.

    In each round the nodes that improved in the round before offer their neighbours a new distance; lineage is
    cut every few rounds, and the loop ends when no node improves.
    """
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    both = edges.select("project_id", at("x1", "y1").alias("u"), at("x2", "y2").alias("v"), "weight")
    both = written(both.unionByName(both.select("project_id", F.col("v").alias("u"), F.col("u").alias("v"), "weight")), "relax-edges")
    best = sources.select("project_id", F.struct("x", "y").alias("v"), F.lit(0.0).alias("d"), F.lit(True).alias("new"))
    while True:
        for _ in range(every):
            front = best.filter("new").select("project_id", F.col("v").alias("u"), "d")
            offer = front.join(both, ["project_id", "u"]).select("project_id", "v", (F.col("d") + F.col("weight")).alias("d"), F.lit(None).cast("double").alias("old"))
            known = best.select("project_id", "v", "d", F.col("d").alias("old")).unionByName(offer)
            least = known.groupBy("project_id", "v").agg(F.min("d").alias("d"), F.min("old").alias("old"))
            best = least.select("project_id", "v", "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("new"))
        best = written(best, "relax")
        if best.filter("new").limit(1).count() == 0:
            return best.select("project_id", F.col("v.x").alias("lon"), F.col("v.y").alias("lat"), "d")


def components(edges: DataFrame) -> DataFrame:
    """Connected component of every node: the smallest node_id it reaches, by labels and pointer jumping."""
    nodes = node_table(edges)
    pair = edges.select("project_id", F.xxhash64("x1", "y1").alias("a"), F.xxhash64("x2", "y2").alias("b"))
    pair = written(pair.unionByName(pair.select("project_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    lab = written(nodes.select("project_id", F.col("node_id").alias("a"), F.col("node_id").alias("l")), "component")
    while True:
        near = pair.join(lab.select("project_id", F.col("a").alias("b"), "l"), ["project_id", "b"]).groupBy("project_id", "a").agg(F.min("l").alias("m"))
        low = lab.join(near, ["project_id", "a"], "left").select("project_id", "a", F.col("l").alias("old"), F.least("l", F.coalesce("m", "l")).alias("l"))
        up = lab.select("project_id", F.col("a").alias("l"), F.col("l").alias("top"))
        fresh = written(low.join(up, ["project_id", "l"], "left").select("project_id", "a", "old", F.least("l", F.coalesce("top", "l")).alias("l")), "component")
        done = fresh.filter("old <> l").limit(1).count() == 0
        lab = fresh.select("project_id", "a", "l")
        if done:
            return nodes.join(lab.select("project_id", F.col("a").alias("node_id"), F.col("l").alias("component")), ["project_id", "node_id"])


def spanning_tree(n: int, pairs: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest; equal weights by node numbers."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for _, a, b in sorted(pairs):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def ring_tour(weight: np.ndarray) -> list[int]:
    """A closed tour of all nodes: a walk round the spanning tree with shortcuts, then exchanges of two legs.

    Distances are those of shortest ways through other nodes, so the tour costs at most twice the tree; legs that
    are shorter through other nodes are written out through them.  Starts and ends at node 0.
    """
    n = len(weight)
    dist, via = weight.astype(float).copy(), np.full((n, n), -1)
    np.fill_diagonal(dist, 0.0)
    for k in range(n):
        through = dist[:, k, None] + dist[None, k, :]
        less = through < dist
        dist[less], via[less] = through[less], k
    near = defaultdict(list)
    for a, b in spanning_tree(n, [(dist[i, j], i, j) for i in range(n) for j in range(i + 1, n)]):
        near[a].append(b)
        near[b].append(a)
    tour, seen, stack = [], set(), [0]
    while stack:
        u = stack.pop()
        if u not in seen:
            seen.add(u)
            tour.append(u)
            stack += sorted(near[u], key=lambda v: -dist[u, v])
    better, far = n > 3, dist.tolist()
    while better:
        better = False
        for i in range(1, n - 1):
            for j in range(i + 1, n):
                a, b, c, d = tour[i - 1], tour[i], tour[j], tour[(j + 1) % n]
                if far[a][c] + far[b][d] < far[a][b] + far[c][d] - 1e-9:
                    tour[i : j + 1] = tour[i : j + 1][::-1]
                    better = True

    def leg(a: int, b: int) -> list[int]:
        k = via[a, b]
        return [b] if k < 0 else leg(a, k) + leg(k, b)

    out = [0]
    for a, b in zip(tour, [*tour[1:], 0], strict=True):
        out += leg(a, b)
    return out


BACKBONE = "project_id long, leg_no int, a int, b int"


def backbone_edges(pairs: DataFrame, mode: str) -> DataFrame:
    """Chosen pairs of a complete graph (project_id, a, b, weight): a spanning tree (``arvore``) or a ring (``anel``).

    A ring of two nodes has two legs over the same pair.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((p["a"], p["b"])))
        at = {int(x): i for i, x in enumerate(ids)}
        rows = [(float(w), at[int(a)], at[int(b)]) for a, b, w in zip(p["a"], p["b"], p["weight"], strict=True)]
        if mode == "anel":
            m = np.full((len(ids), len(ids)), np.inf)
            for w, i, j in rows:
                m[i, j] = m[j, i] = w
            t = ring_tour(m)
            legs = list(zip(t, t[1:], strict=False))
        else:
            legs = spanning_tree(len(ids), rows)
        lo = [int(ids[min(x)]) for x in legs]
        hi = [int(ids[max(x)]) for x in legs]
        return pd.DataFrame({"project_id": p["project_id"].iloc[0], "leg_no": range(1, len(legs) + 1), "a": lo, "b": hi})

    return dealt(pairs.select("project_id", "a", "b", "weight"), "project_id").groupBy("project_id").applyInPandas(run, BACKBONE)
