"""Registered queries with their SQL where SQL can express them; each runs over whole tables."""

from __future__ import annotations

import copy

from pyspark.sql import functions as F

from ..functions import geo, optical
from ..operators import checks, clusters, graph, placement, spatial
from ..sources import buildings, cache, kml
from ..storage import small, written
from . import config as conf
from . import mapping as m
from . import network, sizing

CONFIG = conf.checked(conf.DEFAULT)
E = CONFIG["engenharia"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def with_olt(mode: str = "anel", auto: bool = False) -> dict:
    c = copy.deepcopy(CONFIG)
    c["equipamentos"]["olt"] = {"latitude": m.OLT_LAT, "longitude": m.OLT_LON}
    c["engenharia"]["topologia_backbone"]["modo"] = mode
    c["opcoes_visuais_e_nomes"]["nomear_cto_ceo_automaticamente"] = auto
    return c


# ---- SQL that several oracles share ----
HP = f"hp AS (SELECT c_custkey::BIGINT AS hp_id, c_nationkey::BIGINT AS project_id, {m.HP_LON.format(k='c_custkey')} AS lon, {m.HP_LAT.format(k='c_custkey')} AS lat FROM customer)"
POLY = "poly AS (SELECT n_nationkey::BIGINT AS project_id, n_name AS nome, -44.3e0 + n_nationkey::DOUBLE * 1e-4 AS x1, -44.29e0 - n_nationkey::DOUBLE * 1e-4 AS x2, -2.5e0 + n_nationkey::DOUBLE * 1e-4 AS y1, -2.49e0 - n_nationkey::DOUBLE * 1e-4 AS y2 FROM nation)"
INSIDE = "ins AS (SELECT h.*, p.nome FROM hp h JOIN poly p USING (project_id) WHERE lon BETWEEN x1 AND x2 AND lat BETWEEN y1 AND y2 AND NOT (lon > -44.296e0 AND lon < -44.294e0 AND lat > -2.496e0 AND lat < -2.494e0))"


def hav(a, b, c, d) -> str:
    h = f"(pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin((radians({c}) - radians({a})) / 2), 2))"
    return f"(12742000e0 * atan2(sqrt({h}), sqrt(1 - {h})))"


GRID = """g AS (SELECT p_partkey % 11 AS i, p_partkey // 11 AS j FROM part WHERE p_partkey < 121),
ge AS (SELECT i, j, i + 1 AS a, j AS b FROM g WHERE i < 10 UNION ALL SELECT i, j, i, j + 1 FROM g WHERE j < 10),
gv AS (SELECT i, j, -44.3e0 + i * 0.001e0 AS lon, -2.5e0 + j * 0.001e0 AS lat FROM g)"""
POLES = f"""pl AS (SELECT k AS pole_id, -44.3e0 + (k % 14) * 4e-4 + ((k * 37) % 11) * 1e-5 AS lon, -2.5e0 + (k // 14) * 4e-4 + ((k * 53) % 13) * 1e-5 AS lat FROM (SELECT p_partkey::BIGINT AS k FROM part WHERE p_partkey < 200)
  UNION ALL SELECT * FROM (VALUES (1000::BIGINT, -44.2e0, -2.4e0), (1001::BIGINT, -44.2e0, -2.4e0 + 59.95e0 / 111194.92664455873e0)) t(pole_id, lon, lat)),
sp AS (SELECT a.pole_id AS a, b.pole_id AS b, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2, {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS d FROM pl a JOIN pl b ON a.pole_id < b.pole_id
       WHERE abs(a.lon - b.lon) <= 60e0 / 111320e0 AND abs(a.lat - b.lat) <= 60e0 / 111320e0 AND {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 60)"""


def inside(spark, sf):
    return buildings.matched(m.hps(spark, sf), m.polygons(spark, sf).drop("poly_no"), ["project_id"])


# ---- counting and sizing ----
@query(f"WITH {HP} SELECT project_id, hp_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM hp")
def hp_points(spark, sf):
    return m.hps(spark, sf).select("project_id", "hp_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"WITH {HP}, {POLY}, {INSIDE} SELECT project_id, hp_id, nome FROM ins")
def hp_in_polygon(spark, sf):
    return inside(spark, sf).select("project_id", "hp_id", "nome")


@query(f"WITH {HP}, {POLY}, {INSIDE} SELECT project_id, nome, count(*)::BIGINT AS hp_detectados FROM ins GROUP BY ALL")
def hp_count_by_polygon(spark, sf):
    return buildings.counts(inside(spark, sf), ["project_id", "nome"])


@query(f"WITH {HP} SELECT project_id, count(*)::BIGINT AS n_rows, count(DISTINCT (round(lon, 6), round(lat, 6)))::BIGINT AS n_hp FROM orders JOIN hp ON hp_id = o_custkey GROUP BY project_id")
def hp_distinct(spark, sf):
    rows = m.repeated_hps(spark, sf).withColumn("lon", F.round("lon", 6)).withColumn("lat", F.round("lat", 6))
    n = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return n.join(buildings.distinct_hps(rows, ["project_id"]).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_hp")), "project_id")


@query(f"WITH {HP} SELECT project_id, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM hp GROUP BY project_id")
def project_bbox(spark, sf):
    return network.routing_box(m.hps(spark, sf), None, 0)


@query(f"""WITH {HP}, b AS (SELECT project_id, min(lon) AS a, min(lat) AS b, max(lon) AS c, max(lat) AS d FROM (SELECT project_id, lon, lat FROM hp UNION ALL SELECT DISTINCT project_id, -44.31e0, -2.51e0 FROM hp) GROUP BY project_id)
SELECT project_id, round(a - 150 / (111320e0 * greatest(abs(cos(radians((b + d) / 2))), 0.01e0)), 9) AS min_lon, round(b - 150 / 111320e0, 9) AS min_lat,
       round(c + 150 / (111320e0 * greatest(abs(cos(radians((b + d) / 2))), 0.01e0)), 9) AS max_lon, round(d + 150 / 111320e0, 9) AS max_lat FROM b""")
def bbox_expanded(spark, sf):
    hps = m.hps(spark, sf)
    extra = hps.select("project_id").distinct().select("project_id", F.lit(-44.31).alias("lon"), F.lit(-2.51).alias("lat"))
    box = network.routing_box(hps, extra, float(E["margem_bbox_roteamento_metros"]))
    return box.select("project_id", *[F.round(c, 9).alias(c) for c in box.columns[1:]])


@query()
def geometry_hash(spark, sf):
    return cache.geometry_hash(m.polygons(spark, sf), ["project_id"])


SIZING = """SELECT project_id, hp, ceil(hp * {pen})::BIGINT AS hc, dem AS demanda_hp_planejada, ctos, pons, ceos, dem - hp AS reserva_hp, ctos * 16 AS capacidade_hp_instalada, ctos * 16 - dem AS folga_hp_instalada,
  ctos * 8 AS capacidade_hc_inicial, ctos * 16 AS capacidade_hc_expansao, greatest(0, ceil(hp * {pen})::BIGINT - ctos * 8)::BIGINT AS deficit_hc_inicial, 16 * {pen} AS hc_teorico_por_cto_cheia, pons * 8 AS capacidade_ctos_em_pons,
  pons * 8 - ctos AS folga_ctos_em_pons, ceos * 2 AS capacidade_pons_em_ceos, ceos * 2 - pons AS folga_pons_em_ceos, ceil(hp * {pen})::BIGINT > ctos * 8 AS expansao_splitter_necessaria FROM z"""


def sizing_sql(pen: str, res: str) -> str:
    return f"""WITH {HP}, n AS (SELECT project_id, count(*)::BIGINT AS hp FROM hp GROUP BY project_id), x AS (SELECT *, ceil(hp * (1 + {res}))::BIGINT AS dem FROM n),
y AS (SELECT *, (dem + 15) // 16 AS ctos FROM x), w AS (SELECT *, (ctos + 7) // 8 AS pons FROM y), z AS (SELECT *, (pons + 1) // 2 AS ceos FROM w) {SIZING.format(pen=pen)}"""


def sized(spark, sf, **change):
    c = copy.deepcopy(CONFIG)
    c["engenharia"].update(change)
    return sizing.sized(m.hps(spark, sf).groupBy("project_id").agg(F.count(F.lit(1)).alias("hp")), c)


@query(sizing_sql("0.5e0", "0e0"))
def sizing_default(spark, sf):
    return sized(spark, sf)


@query(sizing_sql("0.5e0", "0.1e0"))
def sizing_reserve(spark, sf):
    return sized(spark, sf, reserva_capacidade_percentual=0.1)


@query(sizing_sql("0.8e0", "0e0"))
def sizing_penetration(spark, sf):
    return sized(spark, sf, penetracao_estimada=0.8)


@query("SELECT s_suppkey::BIGINT AS ctos, (s_suppkey + 7) // 8::BIGINT AS pons, ((s_suppkey + 7) // 8 + 1) // 2::BIGINT AS ceos FROM supplier")
def hierarchy_recompute(spark, sf):
    return sizing.recomputed(m.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("ctos")), "ctos", CONFIG)


@query(f"WITH {HP} SELECT project_id, true AS cto_enough, true AS cto_least, true AS pon_enough, true AS pon_least, true AS ceo_enough, true AS ceo_least FROM hp GROUP BY project_id")
def sizing_invariants(spark, sf):
    rows = sizing.invariants(sized(spark, sf), CONFIG)
    return rows.select("project_id", *[f"{a}_{b}" for a in ("cto", "pon", "ceo") for b in ("enough", "least")])


@query(f"WITH {HP}, {POLY}, {INSIDE}, n AS (SELECT project_id, count(*)::BIGINT AS hp FROM (SELECT DISTINCT project_id, round(lon, 6), round(lat, 6) FROM ins) GROUP BY project_id) SELECT project_id, hp, (hp + 15) // 16 AS ctos, ((hp + 15) // 16 + 7) // 8 AS pons, (((hp + 15) // 16 + 7) // 8 + 1) // 2 AS ceos FROM n")
def hp_sizing(spark, sf):
    hp = buildings.distinct_hps(inside(spark, sf), ["project_id"]).groupBy("project_id").agg(F.count(F.lit(1)).alias("hp"))
    return sizing.sized(hp, CONFIG).select("project_id", "hp", "ctos", "pons", "ceos")


# ---- lengths and optics ----
@query(f"WITH {HP} SELECT hp_id, round({hav('lon', 'lat', '-44.295e0', '-2.495e0')}, 3) AS metres FROM hp")
def haversine_to_olt(spark, sf):
    return m.hps(spark, sf).select("hp_id", F.round(geo.haversine("lon", "lat", m.OLT_LON, m.OLT_LAT), 3).alias("metres"))


@query(f"WITH {HP}, s AS (SELECT *, lead(lon) OVER w AS nx, lead(lat) OVER w AS ny FROM hp WINDOW w AS (PARTITION BY project_id ORDER BY hp_id)) SELECT project_id, round(coalesce(sum({hav('lon', 'lat', 'nx', 'ny')}), 0), 2) AS metres FROM s GROUP BY project_id")
def route_length(spark, sf):
    path = m.hps(spark, sf).groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("hp_id", "lon", "lat"))).alias("p"))
    return path.select("project_id", F.round(geo.path_metres(F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))), 2).alias("metres"))


@query("""SELECT p_partkey::BIGINT AS k, t.kind, round(p_partkey * 1.5001e0 * 1.03e0 + t.extra, 2) AS metres FROM part, (VALUES ('cto', 10e0), ('ceo', 30e0), ('olt', 50e0), ('distribuicao', 0e0)) t(kind, extra)""")
def reserve_metres(spark, sf):
    rows = m.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k"), F.explode(F.array(*[F.lit(x) for x in ("cto", "ceo", "olt", "distribuicao")])).alias("kind"))
    return rows.select("k", "kind", geo.with_reserve(F.col("k") * F.lit(1.5001), F.col("kind"), CONFIG).alias("metres"))


BUDGET = f"WITH {HP}, o AS (SELECT hp_id, round({hav('lon', 'lat', '-44.295e0', '-2.495e0')} * 40, 3) AS metres FROM hp), l AS (SELECT *, metres / 1000e0 * 0.25e0 + 2 * 0.1e0 + 2 * 0.5e0 + (10.5e0 + 13.5e0) AS loss FROM o)"


def budgets(spark, sf):
    rows = m.hps(spark, sf).select("hp_id", F.round(geo.haversine("lon", "lat", m.OLT_LON, m.OLT_LAT) * 40, 3).alias("metres"))
    return rows.withColumn("b", optical.budget(F.col("metres"), F.lit(0.0), 2, CONFIG))


@query(f"{BUDGET} SELECT hp_id, round(loss, 2) AS attenuation_db, round(4.5e0 - loss, 2) AS signal_dbm, loss <= 29.5e0 AS approved FROM l")
def optical_budget(spark, sf):
    return budgets(spark, sf).select("hp_id", "b.*")


@query(f"{BUDGET} SELECT hp_id, CASE WHEN loss <= 29.5e0 THEN 'APROVADO (Sinal Estimado: ' || round(4.5e0 - loss, 2)::VARCHAR || ' dBm | Atenuação: ' || round(loss, 2)::VARCHAR || ' dB)' ELSE 'REPROVADO (Sinal Estimado: ' || round(4.5e0 - loss, 2)::VARCHAR || ' dBm - Abaixo da sensibilidade)' END AS verdict FROM l")
def optical_verdict(spark, sf):
    return budgets(spark, sf).select("hp_id", optical.verdict(F.col("b")).alias("verdict"))


@query(f"{BUDGET} SELECT count(*) FILTER (loss > 29.5e0)::BIGINT AS failed, count(*)::BIGINT AS total FROM l")
def failed_ctos(spark, sf):
    return budgets(spark, sf).agg(F.count_if(~F.col("b.approved")).alias("failed"), F.count(F.lit(1)).alias("total"))


# ---- spatial joins ----
def grid_nodes(spark, sf):
    v = m.street_vertices(spark, sf)
    return v.select("project_id", (F.col("i") * 11 + F.col("j")).alias("node_id"), "lon", "lat").distinct()


def one_project(df):
    return df.withColumn("project_id", F.lit(0).cast("long"))


@query(f"WITH {HP}, {GRID}, q AS (SELECT hp_id, i * 11 + j AS node_id, {hav('hp.lon', 'hp.lat', 'gv.lon', 'gv.lat')} AS m, row_number() OVER (PARTITION BY hp_id ORDER BY (hp.lon - gv.lon) * (hp.lon - gv.lon) + (hp.lat - gv.lat) * (hp.lat - gv.lat), i * 11 + j) AS r FROM hp, gv) SELECT hp_id, node_id::BIGINT AS node_id, round(m, 3) AS metres FROM q WHERE r = 1")
def nearest_node(spark, sf):
    out = spatial.nearest_node(one_project(m.hps(spark, sf)), grid_nodes(spark, sf), "hp_id", ["project_id"], size=0.0005)
    return out.select("hp_id", "node_id", F.round("metres", 3).alias("metres"))


SNAP = f"""WITH {HP}, {GRID}, seg AS (SELECT -44.3e0 + i * 0.001e0 AS ax, -2.5e0 + j * 0.001e0 AS ay, -44.3e0 + a * 0.001e0 AS bx, -2.5e0 + b * 0.001e0 AS by1 FROM ge),
t AS (SELECT hp_id, lon, lat, ax, ay, bx, by1, least(greatest(((lon - ax) * (bx - ax) + (lat - ay) * (by1 - ay)) / ((bx - ax) * (bx - ax) + (by1 - ay) * (by1 - ay)), 0e0), 1e0) AS k FROM hp, seg),
p AS (SELECT hp_id, lon, lat, ax + k * (bx - ax) AS x, ay + k * (by1 - ay) AS y FROM t),
d AS (SELECT *, row_number() OVER (PARTITION BY hp_id ORDER BY (lon - x) * (lon - x) + (lat - y) * (lat - y)) AS r, {hav('lon', 'lat', 'x', 'y')} AS m FROM p)"""


def street_segments(spark, sf):
    return spatial.street_segments(m.street_vertices(spark, sf), ["project_id"])


@query(f"{SNAP} SELECT hp_id, round(m, 3) AS metres FROM d WHERE r = 1")
def snap_to_street(spark, sf):
    out = spatial.snapped(one_project(m.hps(spark, sf)), street_segments(spark, sf), "hp_id", ["project_id"])
    return out.select("hp_id", F.round("snap_m", 3).alias("metres"))


@query(f"{SNAP} SELECT hp_id, m <= 30 AS moved, round(CASE WHEN m <= 30 THEN x ELSE lon END, 8) AS lon, round(CASE WHEN m <= 30 THEN y ELSE lat END, 8) AS lat FROM d WHERE r = 1")
def snap_limit(spark, sf):
    out = spatial.snapped(one_project(m.hps(spark, sf)), street_segments(spark, sf), "hp_id", ["project_id"], 30.0)
    return out.select("hp_id", "moved", F.round("snap_lon", 8).alias("lon"), F.round("snap_lat", 8).alias("lat"))


@query(f"WITH {POLES} SELECT a, b, round(d, 3) AS metres FROM sp")
def pole_spans(spark, sf):
    return spatial.pole_spans(m.poles(spark, sf), ["project_id"]).select("a", "b", F.round("real_dist", 3).alias("metres"))


@query(f"""WITH {POLES}, {GRID}, seg AS (SELECT -44.3e0 + i * 0.001e0 AS x3, -2.5e0 + j * 0.001e0 AS y3, -44.3e0 + a * 0.001e0 AS x4, -2.5e0 + b * 0.001e0 AS y4 FROM ge),
o AS (SELECT sp.a, sp.b, d, sign((x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1)) AS t1, sign((x2 - x1) * (y4 - y1) - (y2 - y1) * (x4 - x1)) AS t2, sign((x4 - x3) * (y1 - y3) - (y4 - y3) * (x1 - x3)) AS t3, sign((x4 - x3) * (y2 - y3) - (y4 - y3) * (x2 - x3)) AS t4 FROM sp, seg
      WHERE greatest(x1, x2) >= least(x3, x4) AND least(x1, x2) <= greatest(x3, x4) AND greatest(y1, y2) >= least(y3, y4) AND least(y1, y2) <= greatest(y3, y4)),
c AS (SELECT DISTINCT a, b FROM o WHERE t1 * t2 <= 0 AND t3 * t4 <= 0)
SELECT sp.a, sp.b, c.a IS NOT NULL AS crosses, round(CASE WHEN c.a IS NOT NULL THEN d * 3 ELSE d END, 3) AS weight FROM sp LEFT JOIN c ON c.a = sp.a AND c.b = sp.b""")
def pole_crossing_penalty(spark, sf):
    out = spatial.crossing_penalty(spatial.pole_spans(m.poles(spark, sf), ["project_id"]), street_segments(spark, sf), ["project_id"])
    return out.select("a", "b", "crosses", F.round("weight", 3).alias("weight"))


# ---- graphs ----
@query(f"WITH {GRID} SELECT count(*)::BIGINT AS edges, 121::BIGINT AS nodes, round(sum({hav('-44.3e0 + i * 0.001e0', '-2.5e0 + j * 0.001e0', '-44.3e0 + a * 0.001e0', '-2.5e0 + b * 0.001e0')}), 2) AS metres FROM ge")
def street_edges(spark, sf):
    e = graph.street_edges(m.street_vertices(spark, sf))
    return e.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("real_dist"), 2).alias("metres")).crossJoin(graph.node_table(e).agg(F.count(F.lit(1)).alias("nodes")))


CUT = f"{GRID}, cut AS (SELECT i * 11 + j AS u, a * 11 + b AS v FROM ge WHERE NOT (i = 4 AND a = 5)), e AS (SELECT u, v FROM cut UNION ALL SELECT v, u FROM cut)"


def numbered(edges):
    """Grid numbers of an edge table's ends."""
    at = lambda x, y: (F.round((F.col(x) + 44.3) * 1000, 0) * 11 + F.round((F.col(y) + 2.5) * 1000, 0)).cast("long")
    return edges.withColumn("u", at("x1", "y1")).withColumn("v", at("x2", "y2"))


@query(f"WITH RECURSIVE {CUT}, r(s, n) AS (SELECT DISTINCT u, u FROM e UNION SELECT r.s, e.v FROM r JOIN e ON e.u = r.n) SELECT size, count(*)::BIGINT AS nodes FROM (SELECT n, count(*) OVER (PARTITION BY k) AS size FROM (SELECT n, min(s) AS k FROM r GROUP BY n)) GROUP BY size")
def street_components(spark, sf):
    c = graph.components(graph.street_edges(m.street_vertices(spark, sf, cut=True)))
    n = c.groupBy("project_id", "component").agg(F.count(F.lit(1)).alias("size"))
    return n.groupBy("size").agg(F.sum("size").alias("nodes"))


def weighted(spark, sf):
    """The cut grid with whole weights, so that sums are exact."""
    e = numbered(graph.street_edges(m.street_vertices(spark, sf, cut=True)))
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    return e.withColumn("weight", (100 + (31 * lo + 17 * hi) % 13).cast("double"))


PATHS = f"""WITH RECURSIVE {CUT}, w AS (SELECT u, v, (100 + (31 * least(u, v) + 17 * greatest(u, v)) % 13)::DOUBLE AS w FROM e),
r(n, d) USING KEY (n) AS (SELECT 0::BIGINT, 0e0 UNION SELECT v, min(x) FROM (SELECT w.v AS v, r.d + w.w AS x FROM r JOIN w ON w.u = r.n) q LEFT JOIN recurring.r k ON k.n = q.v WHERE k.n IS NULL OR q.x < k.d GROUP BY v)"""


@query(f"{PATHS} SELECT n::BIGINT AS node, d AS dist FROM r")
def shortest_path_dist(spark, sf):
    d = graph.shortest_distances(weighted(spark, sf), spark.createDataFrame([(0, -44.3, -2.5)], "project_id long, x double, y double"))
    return d.select((F.round((F.col("lon") + 44.3) * 1000, 0) * 11 + F.round((F.col("lat") + 2.5) * 1000, 0)).cast("long").alias("node"), F.col("d").alias("dist"))


def grid_requests(spark, sf, whole=False):
    """From node 0 to every node of the grid."""
    v = m.street_vertices(spark, sf, whole=whole).select("project_id", "i", "j", "lon", "lat").distinct()
    return v.select("project_id", (F.col("i") * 11 + F.col("j")).alias("req_id"), F.lit(-44.3).alias("o_lon"), F.lit(-2.5).alias("o_lat"), F.col("lon").alias("d_lon"), F.col("lat").alias("d_lat"), F.lit("distribuicao").alias("kind"))


@query(f"WITH {GRID} SELECT CASE WHEN i <= 4 THEN 'OK' ELSE 'SEM_CAMINHO' END AS status, count(*)::BIGINT AS n, (sum(CASE WHEN i <= 4 THEN greatest(i + j + 1, 1) ELSE 0 END))::BIGINT AS points FROM g GROUP BY 1")
def route_status(spark, sf):
    r = graph.routes(grid_requests(spark, sf), graph.street_edges(m.street_vertices(spark, sf, cut=True)), CONFIG)
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("path")).cast("long").alias("points"))


@query(f"""WITH {HP}, {GRID}, q AS (SELECT hp_id, {hav('hp.lon', 'hp.lat', 'gv.lon', 'gv.lat')} AS m, row_number() OVER (PARTITION BY hp_id ORDER BY (hp.lon - gv.lon) * (hp.lon - gv.lon) + (hp.lat - gv.lat) * (hp.lat - gv.lat), gv.lon, gv.lat) AS r FROM hp, gv)
SELECT hp_id, CASE WHEN m > 50 THEN 'FORA_DA_MALHA' ELSE 'OK' END AS status, round(m, 3) AS leg_m FROM q WHERE r = 1""")
def route_access_legs(spark, sf):
    req = one_project(m.hps(spark, sf)).select("project_id", F.col("hp_id").alias("req_id"), F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat"), F.lit(-44.3).alias("d_lon"), F.lit(-2.5).alias("d_lat"), F.lit("cto").alias("kind"))
    r = graph.routes(req, graph.street_edges(m.street_vertices(spark, sf)), CONFIG, 50.0)
    return r.select(F.col("req_id").alias("hp_id"), "status", F.round("snap_o_m", 3).alias("leg_m"))


# ---- the same over every row of part, a grid or a set of poles for each project; by SQL or against brute force in tests ----
@query()
def whole_street_edges(spark, sf):
    e = graph.street_edges(m.street_vertices(spark, sf, whole=True))
    n = graph.node_table(e).groupBy("project_id").agg(F.count(F.lit(1)).alias("nodes"))
    return e.groupBy("project_id").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("real_dist"), 2).alias("metres")).join(n, "project_id")


@query()
def whole_street_components(spark, sf):
    c = graph.components(graph.street_edges(m.street_vertices(spark, sf, cut=True, whole=True)))
    return c.groupBy("project_id", "component").agg(F.count(F.lit(1)).alias("size")).select("project_id", "size")


@query()
def whole_route_status(spark, sf):
    r = graph.routes(grid_requests(spark, sf, whole=True), graph.street_edges(m.street_vertices(spark, sf, cut=True, whole=True)), CONFIG)
    return r.groupBy("project_id", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("path")).cast("long").alias("points"))


@query()
def whole_pole_spans(spark, sf):
    return spatial.pole_spans(m.poles(spark, sf, whole=True), ["project_id"]).select("project_id", "a", "b", F.round("real_dist", 3).alias("metres"))


WHOLE = """g AS (SELECT p_partkey // 121 AS project_id, p_partkey % 121 % 11 AS i, p_partkey % 121 // 11 AS j FROM part),
seg AS (SELECT g.project_id, -44.3e0 + g.i * 0.001e0 AS ax, -2.5e0 + g.j * 0.001e0 AS ay, -44.3e0 + h.i * 0.001e0 AS bx, -2.5e0 + h.j * 0.001e0 AS by1
  FROM g JOIN g h ON h.project_id = g.project_id AND ((h.i = g.i + 1 AND h.j = g.j) OR (h.i = g.i AND h.j = g.j + 1)))"""


@query(f"""WITH {HP}, {WHOLE}, t AS (SELECT hp.*, ax, ay, bx, by1, least(greatest(((lon - ax) * (bx - ax) + (lat - ay) * (by1 - ay)) / ((bx - ax) * (bx - ax) + (by1 - ay) * (by1 - ay)), 0e0), 1e0) AS k FROM hp LEFT JOIN seg USING (project_id)),
p AS (SELECT hp_id, project_id, lon, lat, ax + k * (bx - ax) AS x, ay + k * (by1 - ay) AS y FROM t),
d AS (SELECT *, row_number() OVER (PARTITION BY hp_id ORDER BY (lon - x) * (lon - x) + (lat - y) * (lat - y)) AS r, coalesce({hav('lon', 'lat', 'x', 'y')} <= 30, false) AS moved FROM p)
SELECT project_id, hp_id, moved, round(CASE WHEN moved THEN x ELSE lon END, 8) AS lon, round(CASE WHEN moved THEN y ELSE lat END, 8) AS lat FROM d WHERE r = 1""")
def whole_snap_limit(spark, sf):
    segs = spatial.street_segments(m.street_vertices(spark, sf, whole=True), ["project_id"])
    out = spatial.snapped(m.hps(spark, sf), segs, "hp_id", ["project_id"], 30.0)
    return out.select("project_id", "hp_id", "moved", F.round("snap_lon", 8).alias("lon"), F.round("snap_lat", 8).alias("lat"))


@query(f"""WITH {WHOLE}, pl AS (SELECT p_partkey // 200 AS project_id, p_partkey::BIGINT AS pole_id, -44.3e0 + (p_partkey % 200 % 14) * 4e-4 + ((p_partkey % 200 * 37) % 11) * 1e-5 AS lon, -2.5e0 + (p_partkey % 200 // 14) * 4e-4 + ((p_partkey % 200 * 53) % 13) * 1e-5 AS lat FROM part),
sp AS (SELECT a.project_id, a.pole_id AS a, b.pole_id AS b, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2, {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS d FROM pl a JOIN pl b ON a.project_id = b.project_id AND a.pole_id < b.pole_id
  WHERE abs(a.lon - b.lon) <= 60e0 / 111320e0 AND abs(a.lat - b.lat) <= 60e0 / 111320e0 AND {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 60),
o AS (SELECT a, b, sign((x2 - x1) * (ay - y1) - (y2 - y1) * (ax - x1)) AS t1, sign((x2 - x1) * (by1 - y1) - (y2 - y1) * (bx - x1)) AS t2, sign((bx - ax) * (y1 - ay) - (by1 - ay) * (x1 - ax)) AS t3, sign((bx - ax) * (y2 - ay) - (by1 - ay) * (x2 - ax)) AS t4 FROM sp JOIN seg USING (project_id)
  WHERE greatest(x1, x2) >= least(ax, bx) AND least(x1, x2) <= greatest(ax, bx) AND greatest(y1, y2) >= least(ay, by1) AND least(y1, y2) <= greatest(ay, by1)),
c AS (SELECT DISTINCT a, b FROM o WHERE t1 * t2 <= 0 AND t3 * t4 <= 0)
SELECT project_id::BIGINT AS project_id, sp.a, sp.b, c.a IS NOT NULL AS crosses, round(CASE WHEN c.a IS NOT NULL THEN d * 3 ELSE d END, 3) AS weight FROM sp LEFT JOIN c ON c.a = sp.a AND c.b = sp.b""")
def whole_pole_crossings(spark, sf):
    segs = spatial.street_segments(m.street_vertices(spark, sf, whole=True), ["project_id"])
    out = spatial.crossing_penalty(spatial.pole_spans(m.poles(spark, sf, whole=True), ["project_id"]), segs, ["project_id"])
    return out.select("project_id", "a", "b", "crosses", F.round("weight", 3).alias("weight"))


# ---- clusters ----
CENTRES = f"ct AS (SELECT s_suppkey::BIGINT AS centre_id, {m.HP_LON.replace('7919', '6151').format(k='s_suppkey')} AS lon, {m.HP_LAT.replace('104729', '15331').format(k='s_suppkey')} AS lat FROM supplier)"
NEAR = f"""WITH {HP}, {CENTRES}, s AS (SELECT abs(cos(radians(avg(lat)))) AS f FROM hp),
d AS (SELECT hp_id, centre_id, (hp.lon - ct.lon) * f * ((hp.lon - ct.lon) * f) + (hp.lat - ct.lat) * (hp.lat - ct.lat) AS d2 FROM hp, ct, s),
k AS (SELECT *, row_number() OVER (PARTITION BY hp_id ORDER BY d2, centre_id) AS r FROM d)"""


def nearest_centres(spark, sf, k):
    """The ``k`` nearest of the stated centres for every HP, by scaled squared distance."""
    hps, c = one_project(m.hps(spark, sf)), m.centres(spark, sf)
    f = written(hps.groupBy("project_id").agg(F.abs(F.cos(F.radians(F.avg("lat")))).alias("f")), "factors")
    scaled = lambda df, name: df.join(small(f), "project_id").select("project_id", name, F.col("lon").alias("x"), F.col("lat").alias("y"), "f")
    return spatial.nearest_nodes(scaled(hps, "hp_id"), scaled(c, "centre_id").withColumnRenamed("centre_id", "node_id"), "hp_id", ["project_id"], k)


@query(f"{NEAR} SELECT hp_id, round((max(d2) FILTER (r = 2) - max(d2) FILTER (r = 1)) * 1e12, 2) AS regret, max(centre_id) FILTER (r = 1) AS nearest FROM k WHERE r <= 2 GROUP BY hp_id")
def regret_order(spark, sf):
    two = nearest_centres(spark, sf, 2).groupBy("hp_id").agg(F.max("d2").alias("far"), F.min("d2").alias("near"), F.min_by("node_id", "rank").alias("nearest"))
    return two.select("hp_id", F.round((F.col("far") - F.col("near")) * 1e12, 2).alias("regret"), "nearest")


@query(f"{NEAR} SELECT hp_id, centre_id, r::INT AS rank FROM k WHERE r <= 3")
def candidate_rank(spark, sf):
    return nearest_centres(spark, sf, 3).select("hp_id", F.col("node_id").alias("centre_id"), "rank")


# Customers in the order of their regret take the nearest centre with room, one row a step; ``room`` counts the places left.
GREEDY = f"""WITH RECURSIVE {HP}, {CENTRES}, s AS (SELECT greatest(abs(cos(radians(avg(lat)))), 1e-9) AS f FROM hp),
h AS (SELECT hp_id, lon * f AS x, lat AS y FROM hp, s), c AS (SELECT centre_id, (row_number() OVER (ORDER BY centre_id))::INT AS j, lon * f AS x, lat AS y FROM ct, s),
d AS (SELECT hp_id, j, (h.x - c.x) * (h.x - c.x) + (h.y - c.y) * (h.y - c.y) AS d2 FROM h, c), t AS (SELECT hp_id, list(j ORDER BY d2, j) AS js, list(d2 ORDER BY d2, j) AS ds FROM d GROUP BY hp_id),
o AS MATERIALIZED (SELECT hp_id, js, row_number() OVER (ORDER BY ds[2] - ds[1] DESC, hp_id) AS step FROM t),
r(step, hp_id, j, room) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::INT, (SELECT list(16 ORDER BY j) FROM c)
  UNION ALL SELECT step, hp_id, j, list_transform(room, lambda v, i: CASE WHEN i = j THEN v - 1 ELSE v END)
  FROM (SELECT o.step, o.hp_id, list_filter(o.js, lambda q: r.room[q] > 0)[1] AS j, r.room FROM r JOIN o ON o.step = r.step + 1) p)
SELECT r.hp_id, c.centre_id FROM r JOIN c ON c.j = r.j"""


@query(GREEDY)
def assign_labels(spark, sf):
    return clusters.assigned(one_project(m.hps(spark, sf)), m.centres(spark, sf), 16).select("hp_id", "centre_id")


@query("SELECT count(*)::BIGINT AS hps, true AS all_placed, true AS within_capacity FROM customer")
def assign_capacitated(spark, sf):
    a = clusters.assigned(one_project(m.hps(spark, sf)), m.centres(spark, sf), 16)
    n = a.groupBy("centre_id").agg(F.count(F.lit(1)).alias("n"))
    return a.agg(F.count_distinct("hp_id").alias("hps"), F.count_if(F.col("centre_id").isNull()).alias("out")).crossJoin(n.agg(F.max("n").alias("most"))).select("hps", (F.col("out") == 0).alias("all_placed"), (F.col("most") <= 16).alias("within_capacity"))


def boxes(spark, sf):
    return clusters.hierarchy(m.hps(spark, sf), CONFIG)


LEVELS = f"WITH {HP}, n AS (SELECT project_id, count(*)::BIGINT AS hps FROM hp GROUP BY project_id), l AS (SELECT *, (hps + 15) // 16 AS ctos, ((hps + 15) // 16 + 7) // 8 AS pons, (((hps + 15) // 16 + 7) // 8 + 1) // 2 AS ceos FROM n)"


@query(f"{LEVELS} SELECT project_id, hps, ctos, true AS within_capacity FROM l")
def cluster_ctos(spark, sf):
    n = boxes(spark, sf).groupBy("project_id", "cto").agg(F.count("hp_id").alias("n"))
    return n.groupBy("project_id").agg(F.sum("n").alias("hps"), F.count(F.lit(1)).alias("ctos"), (F.max("n") <= 16).alias("within_capacity"))


@query(f"{LEVELS} SELECT project_id, ctos, pons, true AS within_capacity FROM l")
def group_pons(spark, sf):
    n = boxes(spark, sf).groupBy("project_id", "pon").agg(F.count_distinct("cto").alias("n"))
    return n.groupBy("project_id").agg(F.sum("n").alias("ctos"), F.count(F.lit(1)).alias("pons"), (F.max("n") <= 8).alias("within_capacity"))


@query(f"{LEVELS} SELECT project_id, pons, ceos, true AS within_capacity FROM l")
def group_ceos(spark, sf):
    n = boxes(spark, sf).groupBy("project_id", "ceo").agg(F.count_distinct("pon").alias("n"))
    return n.groupBy("project_id").agg(F.sum("n").alias("pons"), F.count(F.lit(1)).alias("ceos"), (F.max("n") <= 2).alias("within_capacity"))


@query("SELECT 0::BIGINT AS mismatches")
def recount_guard(spark, sf):
    return checks.recount_mismatch(boxes(spark, sf), CONFIG).agg(F.count(F.lit(1)).alias("mismatches"))


@query(f"""WITH {HP}, x AS (SELECT project_id, hp_id // 4 AS cto, hp_id // (CASE WHEN project_id % 3 = 0 THEN 16 ELSE 1600 END) AS pon FROM hp),
n AS (SELECT project_id, count(DISTINCT cto)::BIGINT AS ctos, count(DISTINCT pon)::BIGINT AS pons, count(DISTINCT pon // 2)::BIGINT AS ceos FROM x GROUP BY project_id),
l AS (SELECT *, (ctos + 7) // 8 AS least_pons, ((ctos + 7) // 8 + 1) // 2 AS least_ceos FROM n) SELECT * FROM l WHERE pons <> least_pons OR ceos <> least_ceos""")
def recount_faults(spark, sf):
    """Projects of an allocation by key whose PONs or splice boxes are too many or too few."""
    per_pon = F.when(F.col("project_id") % 3 == 0, 16).otherwise(1600)
    x = m.hps(spark, sf).select("project_id", F.floor(F.col("hp_id") / 4).alias("cto"), F.floor(F.col("hp_id") / per_pon).alias("pon"))
    return checks.recount_mismatch(x.withColumn("ceo", F.floor(F.col("pon") / 2)), CONFIG)


def given(spark, sf):
    """An allocation with faults: boxes by key, some customers twice, some in none."""
    c = m.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("hp_id"))
    member = c.filter("hp_id % 97 <> 5").withColumn("cto_id", F.floor(F.col("hp_id") / 16).cast("long")).unionByName(c.filter("hp_id % 89 = 7").withColumn("cto_id", F.floor(F.col("hp_id") / 16).cast("long") + 1))
    return c, member


GIVEN = "mem AS (SELECT c_custkey AS hp_id, c_custkey // 16 AS cto_id FROM customer WHERE c_custkey % 97 <> 5 UNION ALL SELECT c_custkey, c_custkey // 16 + 1 FROM customer WHERE c_custkey % 89 = 7)"


@query(f"""WITH {GIVEN}, c AS (SELECT cto_id, count(*) AS n FROM mem GROUP BY cto_id)
SELECT 'cto_over_capacity' AS rule, cto_id::VARCHAR AS id FROM c WHERE n > 16
UNION ALL SELECT 'hp_in_several', hp_id::VARCHAR FROM mem GROUP BY hp_id HAVING count(*) > 1
UNION ALL SELECT 'hp_in_none', c_custkey::VARCHAR FROM customer WHERE c_custkey NOT IN (SELECT hp_id FROM mem)""")
def hierarchy_validation(spark, sf):
    hps, member = given(spark, sf)
    ctos = member.groupBy("cto_id").agg(F.collect_list("hp_id").alias("hp_ids"))
    pons = ctos.select(F.floor(F.col("cto_id") / 8).alias("pon_id"), "cto_id").groupBy("pon_id").agg(F.collect_list("cto_id").alias("cto_ids"))
    ceos = pons.select(F.floor(F.col("pon_id") / 2).alias("ceo_id"), "pon_id").groupBy("ceo_id").agg(F.collect_list("pon_id").alias("pon_ids"))
    return checks.violations(hps, ctos, pons, ceos, (16, 8, 2))


@query(f"WITH {GIVEN} SELECT c_custkey::BIGINT AS hp_id, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT hp_id FROM mem)")
def hp_anti(spark, sf):
    hps, member = given(spark, sf)
    return checks.missing(hps, member, "hp_id")


@query(f"WITH {GIVEN} SELECT hp_id::BIGINT AS hp_id, count(*)::BIGINT AS times FROM mem GROUP BY hp_id HAVING count(*) > 1")
def dup_membership(spark, sf):
    return checks.duplicates(given(spark, sf)[1], "hp_id")


@query(f"WITH {GIVEN}, x AS (SELECT hp_id, cto_id, cto_id // 8 AS pon_id, cto_id // 16 AS ceo_id FROM mem), a AS (SELECT cto_id, count(DISTINCT hp_id) AS n FROM x GROUP BY 1), b AS (SELECT pon_id, count(DISTINCT cto_id) AS n FROM x GROUP BY 1), c AS (SELECT ceo_id, count(DISTINCT pon_id) AS n FROM x GROUP BY 1) SELECT (SELECT count(*) FROM a)::BIGINT AS ctos, (SELECT count(*) FILTER (n > 16) FROM a)::BIGINT AS ctos_over, (SELECT max(n) FROM a)::BIGINT AS cto_max, (SELECT count(*) FROM b)::BIGINT AS pons, (SELECT count(*) FILTER (n > 8) FROM b)::BIGINT AS pons_over, (SELECT max(n) FROM b)::BIGINT AS pon_max, (SELECT count(*) FROM c)::BIGINT AS ceos, (SELECT count(*) FILTER (n > 2) FROM c)::BIGINT AS ceos_over, (SELECT max(n) FROM c)::BIGINT AS ceo_max, (SELECT count(DISTINCT hp_id) FROM x)::BIGINT AS hps")
def hierarchy_statistics(spark, sf):
    x = given(spark, sf)[1].withColumn("pon_id", F.floor(F.col("cto_id") / 8)).withColumn("ceo_id", F.floor(F.col("cto_id") / 16))
    return checks.statistics(x, (16, 8, 2))


# ---- orders, names, colours ----
def spots(spark, sf):
    """Suppliers as splice boxes of their nations."""
    s = m.table(spark, sf, "supplier")
    return s.select(F.col("s_nationkey").cast("long").alias("project_id"), F.col("s_suppkey").cast("int").alias("ceo"), F.expr(m.HP_LON.format(k="s_suppkey")).alias("lon"), F.expr(m.HP_LAT.format(k="s_suppkey")).alias("lat"))


SPOTS = f"sp AS (SELECT s_nationkey::BIGINT AS project_id, s_suppkey::INT AS node, {m.HP_LON.format(k='s_suppkey')} AS lon, {m.HP_LAT.format(k='s_suppkey')} AS lat FROM supplier)"
# From the west, then north; on to the nearest box not yet placed.
TOUR = f"""WITH RECURSIVE {SPOTS}, f AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY lon, lat DESC, node) AS k FROM sp),
r(project_id, node, lon, lat, ord, done) AS (SELECT project_id, node, lon, lat, 1, [node] FROM f WHERE k = 1
  UNION ALL SELECT project_id, node, lon, lat, ord + 1, list_append(done, node)
  FROM (SELECT sp.*, r.ord, r.done, row_number() OVER (PARTITION BY sp.project_id ORDER BY {hav('sp.lon', 'sp.lat', 'r.lon', 'r.lat')}, sp.node) AS k FROM r JOIN sp ON sp.project_id = r.project_id AND NOT list_contains(r.done, sp.node)) q WHERE k = 1)
SELECT project_id, node AS ceo, ord::INT AS ceo_ord FROM r"""


@query(TOUR)
def ceo_order(spark, sf):
    return placement.ceo_order(spots(spark, sf))


def made_pons(spark, sf):
    """PONs from customers: splice boxes are groups of four keys, placed at their first."""
    h = m.hps(spark, sf).select("project_id", F.col("hp_id").cast("int").alias("pon"), F.col("lon").alias("pon_lon"), F.col("lat").alias("pon_lat"), F.floor(F.col("hp_id") / 100).cast("int").alias("ceo"))
    return h.withColumn("ceo_lon", F.lit(-44.295)).withColumn("ceo_lat", F.lit(-2.495))


PONS = f"WITH {HP}, p AS (SELECT project_id, hp_id::INT AS pon, (hp_id // 100)::INT AS ceo, lon, lat FROM hp), r AS (SELECT *, row_number() OVER (PARTITION BY project_id, ceo ORDER BY round(sqrt((lon + 44.295e0) * (lon + 44.295e0) + (lat + 2.495e0) * (lat + 2.495e0)), 12), pon)::INT AS pon_rank FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ceo, pon_rank)::INT AS pon_no FROM r)"


def numbered_pons(spark, sf):
    p = made_pons(spark, sf)
    return placement.pon_numbers(p, p.select("project_id", "ceo").distinct().withColumn("ceo_ord", F.col("ceo") + 1))


@query(f"{PONS} SELECT project_id, pon, pon_rank FROM n")
def pon_order(spark, sf):
    return numbered_pons(spark, sf).select("project_id", "pon", "pon_rank")


@query(f"{PONS} SELECT project_id, pon, pon_no, format('{{:03d}}', pon_no) || '_N70_SP' || pon_no || '_SS' || pon_rank AS nome FROM n")
def numbering_names(spark, sf):
    n = numbered_pons(spark, sf)
    return n.select("project_id", "pon", "pon_no", placement.named(F.col("pon_no"), 3, "N70", F.format_string("SP%d_SS%d", "pon_no", "pon_rank")).alias("nome"))


@query(f"{PONS} SELECT project_id, ceo, CASE WHEN min(pon_no) <> max(pon_no) THEN 'SP' || min(pon_no) || '-' || max(pon_no) ELSE 'SP' || min(pon_no) END AS tag FROM n GROUP BY project_id, ceo")
def pon_tag(spark, sf):
    return placement.pon_tag(numbered_pons(spark, sf)).select("project_id", "ceo", "tag")


@query("SELECT p_partkey::BIGINT AS n, ['ffff0000', 'ff00ff00', 'ff00ffff', 'ffff00ff', 'ff0088ff', 'ffff00aa'][(p_partkey - 1 + 6) % 6 + 1] AS colour, 'ff00ffff' AS plain FROM part")
def palette(spark, sf):
    return m.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("n"), placement.pon_colour(F.col("p_partkey")).alias("colour"), placement.pon_colour(F.col("p_partkey"), False).alias("plain"))


# ---- backbone and the whole plan ----
PAIRS = f"WITH {SPOTS}, pr AS (SELECT a.project_id, a.node AS a, b.node AS b, {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS w FROM sp a JOIN sp b ON a.project_id = b.project_id AND a.node < b.node)"


def straight_pairs(spark, sf):
    rows = placement.backbone_requests(spots(spark, sf).withColumnRenamed("ceo", "node"))
    return rows.withColumn("status", F.lit("OK")).withColumn("dist_m", F.col("straight_m"))


@query(f"{PAIRS} SELECT project_id, a, b, CASE WHEN a = 0 THEN 'olt' ELSE 'ceo' END AS kind, round(w, 3) AS straight_m FROM pr")
def backbone_pairs(spark, sf):
    return straight_pairs(spark, sf).select("project_id", "a", "b", "kind", F.round("straight_m", 3).alias("straight_m"))


def tree_legs(spark, sf, mode):
    pairs = placement.backbone_weight(straight_pairs(spark, sf))
    return graph.backbone_edges(pairs, mode).join(pairs.select("project_id", "a", "b", "weight"), ["project_id", "a", "b"])


# An edge is in the spanning tree exactly if no other way joins its ends over lighter edges alone: highest edges by closure.
@query(f"""WITH RECURSIVE base AS ({PAIRS} SELECT project_id, a, b, w FROM pr), e AS (SELECT project_id, a, b, w FROM base UNION ALL SELECT project_id, b, a, w FROM base),
r(project_id, s, n, d) USING KEY (project_id, s, n) AS (SELECT project_id, a, b, w FROM e UNION SELECT q.project_id, q.s, q.v, min(q.x) FROM (SELECT e.project_id, r.s, e.b AS v, greatest(r.d, e.w) AS x FROM r JOIN e ON e.project_id = r.project_id AND e.a = r.n) q
  LEFT JOIN recurring.r k ON k.project_id = q.project_id AND k.s = q.s AND k.n = q.v WHERE (k.n IS NULL OR q.x < k.d) AND q.s <> q.v GROUP BY q.project_id, q.s, q.v)
SELECT base.project_id, count(*)::BIGINT AS legs, round(sum(w), 2) AS metres FROM base JOIN r ON r.project_id = base.project_id AND r.s = a AND r.n = b WHERE w <= d GROUP BY base.project_id""")
def backbone_mst(spark, sf):
    return tree_legs(spark, sf, "arvore").groupBy("project_id").agg(F.count(F.lit(1)).alias("legs"), F.round(F.sum("weight"), 2).alias("metres"))


@query(f"WITH {SPOTS} SELECT project_id, count(*)::BIGINT AS nodes, true AS closed, true AS at_most_twice_the_tree FROM sp GROUP BY project_id HAVING count(*) > 1")
def backbone_ring(spark, sf):
    ring, tree = tree_legs(spark, sf, "anel"), tree_legs(spark, sf, "arvore").groupBy("project_id").agg(F.sum("weight").alias("least"))
    ends = ring.select("project_id", F.explode(F.array("a", "b")).alias("n")).groupBy("project_id", "n").agg(F.count(F.lit(1)).alias("deg"))
    ends = ends.groupBy("project_id").agg(F.count(F.lit(1)).alias("nodes"), (F.count_if(F.col("deg") % 2 == 1) == 0).alias("closed"))
    cost = ring.groupBy("project_id").agg(F.sum("weight").alias("cost")).join(tree, "project_id")
    return ends.join(cost, "project_id").select("project_id", "nodes", "closed", (F.col("cost") <= 2 * F.col("least") + 1e-6).alias("at_most_twice_the_tree"))


# A tree over customers: each hangs from the one at half its number; the OLT is node 0.
@query("WITH RECURSIVE t(k, d) AS (SELECT 0::BIGINT, 0e0 UNION ALL SELECT c_custkey::BIGINT, t.d + 10 + c_custkey % 7 FROM customer JOIN t ON c_custkey // 2 = t.k WHERE c_custkey > 0) SELECT CASE WHEN k = 0 THEN 'olt' ELSE k::VARCHAR END AS node, d AS fibre_m FROM t")
def fibre_distance(spark, sf):
    c = m.table(spark, sf, "customer").filter("c_custkey > 0").select(F.col("c_custkey").cast("long").alias("k"))
    name = lambda x: F.when(x == 0, "olt").otherwise(x.cast("string"))
    cables = c.select(F.lit(0).cast("long").alias("project_id"), name(F.floor(F.col("k") / 2)).alias("a"), name(F.col("k")).alias("b"), (10 + F.col("k") % 7).cast("double").alias("dist_m"), F.col("k").alias("seq"))
    return placement.fibre_lengths(cables).select("node", "fibre_m")


def streets_for_all(spark, sf, cut=False):
    """The street grid for every project."""
    v = m.street_vertices(spark, sf, cut).select("way_id", "seq", "lon", "lat")
    return v.crossJoin(F.broadcast(m.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("project_id")))).select("project_id", "way_id", "seq", "lon", "lat")


def whole_plan(spark, sf, mode="anel", auto=False, cut=False):
    c = with_olt(mode, auto)
    c["engenharia"]["distancia_maxima_snap_metros"] = 50 if cut else 80
    return network.plan(m.hps(spark, sf), streets_for_all(spark, sf, cut), c)


@query(f"{LEVELS} SELECT project_id, ctos AS links, true AS one_each, true AS not_shorter FROM l")
def distribution_cables(spark, sf):
    p = whole_plan(spark, sf)
    good = p.cables.filter("scope = 'distribuicao'").select("project_id", "b_id", (F.col("dist_m") + 0.01 >= geo.haversine("o_lon", "o_lat", "d_lon", "d_lat")).alias("long"))
    bad = p.exceptions.filter("scope = 'distribuicao'").select("project_id", "b_id", F.lit(True).alias("long"))
    rows = good.unionByName(bad)
    return rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("links"), (F.count_distinct("b_id") == F.count(F.lit(1))).alias("one_each"), F.bool_and("long").alias("not_shorter"))


@query()
def routing_exceptions(spark, sf):
    p = whole_plan(spark, sf, cut=True)
    return p.exceptions.select("project_id", "exc_no", "scope", "status", "link", "a_ref", "b_ref", "message", F.round("snap_o_m", 3).alias("snap_o_m"), F.round("snap_d_m", 3).alias("snap_d_m"))


@query(f"{LEVELS} SELECT project_id, ctos AS boxes, hps FROM l")
def cto_order(spark, sf):
    p = whole_plan(spark, sf, "arvore", True)
    ok = p.ctos.groupBy("project_id", "pon").agg(F.count(F.lit(1)).alias("n"), F.max("ss").alias("last"), F.sum("n_hp").alias("hp"))
    return ok.filter("n = last").groupBy("project_id").agg(F.sum("n").alias("boxes"), F.sum("hp").alias("hps"))


@query()
def cto_verdicts(spark, sf):
    p = whole_plan(spark, sf, "arvore", True)
    return p.ctos.select("project_id", "cto", "nome", "n_hp", "pon_no", "ss", "attenuation_db", "signal_dbm", "fibre_m", "approved", "verdict")


@query()
def report_json(spark, sf):
    return network.report(whole_plan(spark, sf))


# ---- files and configuration ----
@query(f"WITH {HP} SELECT project_id, hp_id, lon, lat FROM hp")
def kml_roundtrip_points(spark, sf):
    layer = kml.point_layer(m.hps(spark, sf).withColumn("nome", F.concat(F.lit("HP "), F.col("hp_id").cast("string"))), "HP & <teste>", ["project_id"], "hp_id")
    at = F.explode(F.arrays_zip(F.xpath("kml", F.lit("//*[local-name()='Placemark']/*[local-name()='name']/text()")).alias("n"), F.xpath("kml", F.lit("//*[local-name()='coordinates']/text()")).alias("c"))).alias("x")
    rows = layer.select("project_id", at).withColumn("p", kml.coordinates_column(F.col("x.c"))[0])
    return rows.select("project_id", F.regexp_extract("x.n", "[0-9]+", 0).cast("long").alias("hp_id"), "p.lon", "p.lat")


@query("SELECT n_nationkey::BIGINT AS project_id, n_name AS nome, 2 AS rings, 10 AS points FROM nation")
def kml_polygon_parse(spark, sf):
    """Polygons written as coordinate texts and parsed again."""
    text = lambda r: F.array_join(F.transform(r, lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit(",0"))), " ")
    rows = m.polygons(spark, sf).withColumn("c", F.transform("rings", text)).withColumn("back", F.transform("c", kml.coordinates_column))
    return rows.select("project_id", "nome", F.size("back").alias("rings"), F.aggregate("back", F.lit(0), lambda a, r: a + F.size(r)).alias("points"))


@query(f"WITH {POLY} SELECT project_id, round((x1 + x2) / 2, 6) AS lon, round((y1 + y2) / 2, 6) AS lat FROM poly")
def wkb_centroids(spark, sf):
    from ..functions.shapes import wkb_udf

    b = m.polygons(spark, sf).select("project_id", wkb_udf("rings").alias("geometry"))
    return buildings.centroids(b).select("project_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


LEAF = "path string, kind string, num double, txt string"


def leaves_of(c: dict) -> list[tuple]:
    rows, todo = [], [("", c)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{at}.{k}".lstrip("."), x) for k, x in v.items()]
        else:
            k = conf._kind(v)
            rows.append((at, k, float(v) if k in "in" else None, v if k == "s" else None))
    return rows


def leaves(spark):
    """Two configurations as leaf rows: the default one and one with faults."""
    bad = copy.deepcopy(CONFIG)
    bad["engenharia"]["ctos_por_pon"] = True
    bad["engenharia"]["penetracao_estimada"] = 0
    bad["engenharia"]["topologia_backbone"]["modo"] = "estrela"
    bad["cache"]["versao"] = " "
    del bad["api"]["overpass_retry_max"]
    rows = [(n, *leaf) for n, c in ((1, CONFIG), (2, bad)) for leaf in leaves_of(c)]
    return spark.createDataFrame(rows, f"config_id int, {LEAF}")


@query("SELECT * FROM (VALUES (2, 'engenharia.ctos_por_pon', 'type'), (2, 'engenharia.penetracao_estimada', 'value'), (2, 'engenharia.topologia_backbone.modo', 'value'), (2, 'cache.versao', 'value'), (2, 'api.overpass_retry_max', 'missing')) t(config_id, path, reason)")
def config_rules(spark, sf):
    return conf.check_leaves(leaves(spark))


@query(f"""WITH c AS (SELECT s_suppkey::BIGINT AS config_id, 1 + s_suppkey % 24 AS ini, 8 + s_suppkey * 7 % 16 AS mx, s_suppkey * 5 % 24 AS cap, s_suppkey % 3 = 0 AS no_lat, s_suppkey % 5 = 0 AS no_lon FROM supplier), ok AS (SELECT * FROM c WHERE cap > 0)
SELECT config_id, '{conf.CROSS[0]}' AS rule FROM ok WHERE ini > mx UNION ALL SELECT config_id, '{conf.CROSS[1]}' FROM ok WHERE mx < cap UNION ALL SELECT config_id, '{conf.CROSS[2]}' FROM ok WHERE no_lat <> no_lon""")
def config_cross_rules(spark, sf):
    """A configuration for each supplier, some with fields at odds, some with a capacity of none."""
    k = F.col("config_id")
    change = {"engenharia.splitter_cto_inicial": 1 + k % 24, "engenharia.splitter_cto_expansao": 8 + k * 7 % 16, "engenharia.capacidade_hp_por_cto": k * 5 % 24}
    place = {"equipamentos.olt.latitude": (k % 3 == 0, m.OLT_LAT), "equipamentos.olt.longitude": (k % 5 == 0, m.OLT_LON)}
    base = F.broadcast(spark.createDataFrame(leaves_of(CONFIG), LEAF))  # the leaves of one configuration
    rows = m.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("config_id")).crossJoin(base)
    num, kind = F.col("num"), F.col("kind")
    for path, value in change.items():
        num = F.when(F.col("path") == path, value.cast("double")).otherwise(num)
    for path, (none, value) in place.items():
        num = F.when(F.col("path") == path, F.when(~none, F.lit(value))).otherwise(num)
        kind = F.when(F.col("path") == path, F.when(none, "null").otherwise("n")).otherwise(kind)
    return conf.check_cross(rows.withColumns({"num": num, "kind": kind}))


@query("SELECT * FROM (VALUES (1, ''), (2, 'schema'), (3, 'versão'), (4, 'geometria'), (5, 'expiração'), (6, 'expiração'), (7, 'schema,versão,geometria,expiração'), (8, 'expiração')) t(id, reasons)")
def cache_validity(spark, sf):
    rows = [(1, 2, "2.0", "a", "2030-01-01T00:00:00+00:00"), (2, 1, "2.0", "a", "2030-01-01T00:00:00+00:00"), (3, 2, "1.0", "a", "2030-01-01T00:00:00"), (4, 2, "2.0", "b", "2030-01-01"), (5, 2, "2.0", "a", "2020-01-01T00:00:00Z"), (6, 2, "2.0", "a", "soon"), (7, None, None, None, None), (8, 2, "2.0", "a", "2025-01-01T00:00:00Z")]
    df = spark.createDataFrame(rows, "id int, schema_version int, cache_version string, geometry_hash string, expires_at string").withColumn("current_hash", F.lit("a"))
    return df.select("id", F.array_join(cache.reasons("2.0", F.to_timestamp(F.lit("2025-01-01T00:00:00Z"))), ",").alias("reasons"))
