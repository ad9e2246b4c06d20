"""Spatial joins as equi-joins on grid cells: containment, nearest node, nearest street point, spans, crossings.

Every join keys on (cx, cy) cells, plus further equality columns, so Spark hashes or broadcasts it; the exact
geometric test is a residual predicate.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import small, unmeasured, written


def points_in_polygons(points: DataFrame, polygons: DataFrame, keys: list[str] | None = None, size: float = 0.002) -> DataFrame:
    """Points (lon, lat) with the polygons (rings, min_x..max_y) that cover them, boundary included.

    A point may match several polygons.  ``keys``: columns equal on both sides.  A polygon's cells are ``size``
    times a power of four, so that its box touches 81 cells at most; a point looks into one cell of every power
    that some polygon has.  Rings join only the points within the box.
    """
    keys, box = keys or [], ["min_x", "min_y", "max_x", "max_y"]
    numbered = written(polygons.withColumn("_p", F.monotonically_increasing_id()), "polygons")
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(0.0))
    level = F.greatest(F.ceil(F.log(4.0, F.greatest(extent / (8 * size), F.lit(1.0)))), F.lit(0)).cast("int")
    boxes = numbered.select(*keys, "_p", *box, level.alias("_l"))
    levels = sorted(r[0] for r in boxes.select("_l").distinct().collect() if r[0] is not None)  # some ten at most
    width = F.lit(size) * F.pow(F.lit(4.0), F.col("_l"))
    dealt = boxes.select("*", F.explode(geo.cells_of_box(*box, width)).alias("_c")).select("*", "_c.*").drop("_c")
    placed = points.withColumn("_l", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    placed = placed.withColumn("cx", geo.cell("lon", width)).withColumn("cy", geo.cell("lat", width))
    hits = placed.join(dealt, [*keys, "_l", "cx", "cy"])
    hits = hits.filter(F.col("lon").between(F.col("min_x"), F.col("max_x")) & F.col("lat").between(F.col("min_y"), F.col("max_y"))).drop("_l", "cx", "cy", *box)
    hits = hits.join(small(numbered.drop(*keys, *box)), "_p")
    return hits.filter(geo.covered_by("lon", "lat", "rings")).drop("_p", "rings")


def nearest_node(points: DataFrame, nodes: DataFrame, point_id: str, keys: list[str], size: float = 0.001) -> DataFrame:
    """For each point the node (node_id, lon, lat) nearest in planar degrees, ties to the lowest id.

    Looks through the nine cells around a point; a result is final if it lies no farther than one cell.
    Points without a final result go on with cells four times as wide, until the cells cover all nodes.
    """
    ends = nodes.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    slim = points.select(*keys, point_id, F.col("lon").alias("plon"), F.col("lat").alias("plat"))
    empty = slim.select(*keys, point_id, F.lit(None).cast(nodes.schema["node_id"].dataType).alias("node_id"), F.lit(None).cast("double").alias("node_lon"), F.lit(None).cast("double").alias("node_lat"), F.lit(None).cast("double").alias("metres"))
    if ends[0] is None:
        return empty
    far = slim.agg(F.min("plon"), F.max("plon"), F.min("plat"), F.max("plat")).first()
    if far[0] is None:
        return empty
    extent = max(ends[1], far[1]) - min(ends[0], far[0]) + max(ends[3], far[3]) - min(ends[2], far[2])
    out, todo = None, slim
    while True:
        last = size > extent
        placed = todo.select("*", F.explode(geo.cells_around("plon", "plat", size)).alias("_c")).select("*", "_c.*").drop("_c")
        there = nodes.select(*keys, "node_id", "lon", "lat", geo.cell("lon", size).alias("cx"), geo.cell("lat", size).alias("cy"))
        d2 = (F.col("lon") - F.col("plon")) * (F.col("lon") - F.col("plon")) + (F.col("lat") - F.col("plat")) * (F.col("lat") - F.col("plat"))
        best = placed.join(there, [*keys, "cx", "cy"]).groupBy(*keys, point_id, "plon", "plat").agg(F.min(F.struct(d2.alias("d2"), "node_id", "lon", "lat")).alias("b"))
        if not last:
            best = best.filter(F.col("b.d2") <= size * size)
        best = written(best, "nearest")
        out = best if out is None else out.unionByName(best)
        if last:
            break
        todo = todo.join(best.select(*keys, point_id), [*keys, point_id], "left_anti")
        if todo.limit(1).count() == 0:
            break
        todo, size = written(todo, "nearest-todo"), size * 4
    return out.select(*keys, point_id, F.col("b.node_id").alias("node_id"), F.col("b.lon").alias("node_lon"), F.col("b.lat").alias("node_lat"), geo.haversine("plon", "plat", "b.lon", "b.lat").alias("metres"))


def _crowd(nodes: DataFrame, keys: list[str], size: float) -> float:
    """Nodes in the cell of a node, on average over the nodes."""
    n = nodes.groupBy(*keys, geo.cell("_x", size).alias("cx"), geo.cell("y", size).alias("cy")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]


def nearest_nodes(points: DataFrame, nodes: DataFrame, point_id: str, keys: list[str], k: int, size: float | None = None) -> DataFrame:
    """For each point its ``k`` nearest nodes by planar distance (node_id, d2, rank from 1), ties to the lowest id.

    Points and nodes are given as x, y in one scale, or with a further column ``f``, by which differences in x are
    multiplied (one value for equal keys).  Cells start as wide as the crowd of nodes asks for, unless ``size`` is
    given; the nodes of a cell and the eight around it lie in one array, so a point meets some dozens of nodes within
    its own row and no pairs are shuffled.  Cells widen fourfold for the points whose k-th node lies farther than one
    cell; a point with fewer than ``k`` nodes ends with all of them.
    """
    f = "f" in nodes.columns
    wide = lambda df: df.withColumn("_x", F.col("x") * F.col("f") if f else F.col("x"))
    # Of the nodes of one place only the k lowest ids can be among a point's k nearest.
    same = Window.partitionBy(*keys, "x", "y").orderBy("node_id")
    nodes = wide(nodes).withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= k).select(*keys, "node_id", "x", "y", "_x")
    nodes = written(nodes, "nearest-nodes")
    todo = wide(points).select(*keys, point_id, F.col("x").alias("px"), F.col("y").alias("py"), "_x", (F.col("f") if f else F.lit(1.0)).alias("_f"))
    bounds = lambda df, y: df.agg(F.min("_x"), F.max("_x"), F.min(y), F.max(y), F.count(F.lit(1))).first()
    ends, far = bounds(nodes, "y"), bounds(todo, "py")
    extent = 0.0
    if ends[0] is not None and far[0] is not None:
        extent = max(ends[1], far[1]) - min(ends[0], far[0]) + max(ends[3], far[3]) - min(ends[2], far[2])
    if size is None:
        over = max(ends[1] - ends[0], ends[3] - ends[2]) if ends[0] is not None else 0.0
        size = over * math.sqrt((k + 1) / (2 * max(ends[4], 1))) or 0.001
        while size > over * 1e-9 and over > 0 and _crowd(nodes, keys, size) > 4 * (k + 1):
            size /= 4
    out = None
    dx, dy = lambda q: (F.col("px") - q["x"]) * F.col("_f"), lambda q: F.col("py") - q["y"]
    while True:
        last = size > extent
        dealt = nodes.select("*", F.explode(geo.cells_around("_x", "y", size)).alias("_c")).select(*keys, "_c.*", "node_id", "x", "y")
        near = dealt.groupBy(*keys, "cx", "cy").agg(F.collect_list(F.struct("node_id", "x", "y")).alias("near"))
        met = todo.withColumn("cx", geo.cell("_x", size)).withColumn("cy", geo.cell("py", size)).join(unmeasured(near), [*keys, "cx", "cy"])
        ranked = F.sort_array(F.transform("near", lambda q: F.struct((dx(q) * dx(q) + dy(q) * dy(q)).alias("d2"), q["node_id"].alias("node_id"))))
        best = met.select(*keys, point_id, F.slice(ranked, 1, k).alias("b"))
        if not last:
            within = (size * (1 - 1e-6)) ** 2  # what lies beyond the nine cells is farther, whatever rounding does at their edges
            best = written(best.filter((F.size("b") == k) & (F.col("b")[k - 1]["d2"] <= within)), "nearest-few")
        out = best if out is None else out.unionByName(best)
        if not last:
            todo = written(todo.join(unmeasured(best.select(*keys, point_id)), [*keys, point_id], "left_anti"), "nearest-few-todo")
            last = todo.limit(1).count() == 0
        if last:
            return out.select(*keys, point_id, F.posexplode("b").alias("rank", "_b")).select(*keys, point_id, "_b.node_id", "_b.d2", (F.col("rank") + 1).alias("rank"))
        size *= 4


def street_segments(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Segments x1, y1, x2, y2 of consecutive vertices (way_id, seq, lon, lat)."""
    by = Window.partitionBy(*keys, "way_id").orderBy("seq")
    rows = vertices.select(*keys, "way_id", "seq", F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.lead("lon").over(by).alias("x2"), F.lead("lat").over(by).alias("y2"))
    return rows.filter("x2 is not null").withColumn("seg_id", F.concat_ws(":", "way_id", "seq"))


def _within(points: DataFrame, segs: DataFrame, keys: list[str], limit_m: float) -> DataFrame:
    """Points with the segments near them: all that come within ``limit_m`` metres, and some beyond.

    Cells are as wide as the limit is in degrees of longitude, by bands of one degree of latitude, so that points
    near a pole widen no cells but their own.  A segment is dealt to every band it may serve.
    """
    def width(band):
        lat = F.least(F.greatest(F.abs(band), F.abs(band + 1)), F.lit(89)).cast("double")
        return F.lit(max(limit_m, 1.0) / (geo.DEGREE_M * 0.998)) / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))

    reach = max(limit_m, 1.0) / (geo.DEGREE_M * 0.998 * math.cos(math.radians(89)))
    box = [F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2")]
    bands = F.sequence(F.floor(box[1] - reach).cast("long"), F.floor(box[3] + reach).cast("long"))
    placed = points.withColumn("band", F.floor("lat").cast("long")).withColumn("_w", width(F.col("band")))
    placed = placed.select("*", F.explode(geo.cells_around("lon", "lat", F.col("_w"))).alias("_c")).select("*", "_c.*").drop("_c", "_w")
    dealt = segs.select(*keys, "seg_id", "x1", "y1", "x2", "y2", F.explode(bands).alias("band")).withColumn("_w", width(F.col("band")))
    low, high = F.greatest(box[1], F.col("band") - reach), F.least(box[3], F.col("band") + 1 + reach)
    dealt = dealt.select("*", F.explode(geo.cells_of_box(box[0], low, box[2], high, F.col("_w"))).alias("_c")).select("*", "_c.*").drop("_c", "_w")
    return placed.join(unmeasured(dealt), [*keys, "band", "cx", "cy"])


def snapped(points: DataFrame, segs: DataFrame, point_id: str, keys: list[str], limit_m: float | None = None, size: float = 0.001) -> DataFrame:
    """Points moved to the nearest street point in planar degrees if that is at most ``limit_m`` metres away.

    Adds snap_lon, snap_lat, snap_m (null if no street is near) and ``moved``; a point over the limit or without
    streets keeps its place.  With a limit the cells are as wide as it (``_within``), so nine cells hold every
    candidate; without one, cells widen until each point has found a street.
    """
    ends = segs.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    slim, found = points.select(*keys, point_id, "lon", "lat"), None
    extent = 0 if ends[0] is None else 2 * (ends[1] - ends[0] + ends[3] - ends[2]) + 4 * size
    todo = slim
    near = geo.on_segment("lon", "lat", "x1", "y1", "x2", "y2")
    first = F.min(F.struct(F.col("n.d2").alias("d2"), "seg_id", F.col("n.x").alias("x"), F.col("n.y").alias("y"))).alias("b")
    while ends[0] is not None:
        if limit_m is not None:
            found = _within(todo, segs, keys, limit_m).withColumn("n", near).groupBy(*keys, point_id).agg(first)
            break
        placed = todo.select("*", F.explode(geo.cells_around("lon", "lat", size)).alias("_c")).select("*", "_c.*").drop("_c")
        box = geo.cells_of_box(F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"), size)
        dealt = segs.select(*keys, "seg_id", "x1", "y1", "x2", "y2", F.explode(box).alias("_c")).select("*", "_c.*").drop("_c")
        best = placed.join(unmeasured(dealt), [*keys, "cx", "cy"]).withColumn("n", near).groupBy(*keys, point_id).agg(first)
        last = size > extent
        best = written(best if last else best.filter(F.col("b.d2") <= size * size), "snap")
        found = best if found is None else found.unionByName(best)
        todo = todo.join(unmeasured(best.select(*keys, point_id)), [*keys, point_id], "left_anti")
        if last or todo.limit(1).count() == 0:
            break
        todo, size = written(todo, "snap-todo"), size * 4
    if found is None:
        return points.select("*", F.col("lon").alias("snap_lon"), F.col("lat").alias("snap_lat"), F.lit(None).cast("double").alias("snap_m"), F.lit(False).alias("moved"))
    joined = points.join(unmeasured(found), [*keys, point_id], "left").withColumn("snap_m", geo.haversine("lon", "lat", "b.x", "b.y"))
    ok = F.col("snap_m").isNotNull() if limit_m is None else F.coalesce(F.col("snap_m") <= float(limit_m), F.lit(False))
    return joined.select(*points.columns, F.when(ok, F.col("b.x")).otherwise(F.col("lon")).alias("snap_lon"), F.when(ok, F.col("b.y")).otherwise(F.col("lat")).alias("snap_lat"), "snap_m", ok.alias("moved"))


def pole_spans(poles: DataFrame, keys: list[str], limit_m: float = 60.0) -> DataFrame:
    """Pairs of poles (a < b) within ``limit_m`` metres and within the same limit in degrees on both axes."""
    box = limit_m / geo.DEGREE_M
    here = poles.select(*keys, F.col("pole_id").alias("a"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.explode(geo.cells_around("lon", "lat", box)).alias("_c")).select("*", "_c.*").drop("_c")
    there = poles.select(*keys, F.col("pole_id").alias("b"), F.col("lon").alias("x2"), F.col("lat").alias("y2"), geo.cell("lon", box).alias("cx"), geo.cell("lat", box).alias("cy"))
    pairs = here.join(unmeasured(there), [*keys, "cx", "cy"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("x1") - F.col("x2")) <= box) & (F.abs(F.col("y1") - F.col("y2")) <= box))
    return pairs.withColumn("real_dist", geo.haversine("x1", "y1", "x2", "y2")).filter(F.col("real_dist") <= limit_m).drop("cx", "cy")


def crossing_penalty(spans: DataFrame, segs: DataFrame, keys: list[str], factor: float = 3.0, size: float = 0.001) -> DataFrame:
    """Spans with ``weight``: the length, times ``factor`` once if any street touches the span."""
    box = lambda: geo.cells_of_box(F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"), size)
    a = spans.select(*keys, "a", "b", "x1", "y1", "x2", "y2", F.explode(box()).alias("_c")).select("*", "_c.*").drop("_c")
    s = segs.select(*keys, "x1", "y1", "x2", "y2", F.explode(box()).alias("_c")).select(*keys, F.col("x1").alias("x3"), F.col("y1").alias("y3"), F.col("x2").alias("x4"), F.col("y2").alias("y4"), "_c.*")
    hit = a.join(unmeasured(s), [*keys, "cx", "cy"]).filter(geo.touching("x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4")).select(*keys, "a", "b").distinct().withColumn("crosses", F.lit(True))
    out = spans.join(unmeasured(hit), [*keys, "a", "b"], "left").withColumn("crosses", F.coalesce("crosses", F.lit(False)))
    return out.withColumn("weight", F.when(F.col("crosses"), F.col("real_dist") * factor).otherwise(F.col("real_dist")))


