"""Geometry on longitude and latitude as column expressions.

Three notions of distance are kept apart: haversine metres, planar degrees (nearest points on streets and
graph nodes), and degrees scaled by the cosine of a mean latitude (clustering).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The earth's radius for lengths, and metres in a degree for margins and boxes.
EARTH_M, DEGREE_M = 6_371_000.0, 111_320.0

POINT = "struct<lon:double,lat:double>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres between two points."""
    a, b, c, d = (F.radians(_c(x)) for x in (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin((d - b) / 2), F.lit(2.0)) + F.cos(b) * F.cos(d) * F.pow(F.sin((c - a) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def rounded(x, digits: int) -> Column:
    """A double rounded as SQL engines do in binary: a whole number of units, halves away from zero, divided again."""
    unit = F.lit(10.0**digits)
    return F.round(_c(x) * unit, 0) / unit


def path_metres(path) -> Column:
    """Length of an array of points; 0 for fewer than two."""
    p = _c(path)
    legs = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: haversine(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.when(F.size(p) > 1, F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def without_repeats(path) -> Column:
    """An array of points without those equal to the point kept before."""
    p = _c(path)
    return F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, F.greatest(i - 1, F.lit(0)))))


def cell(x, size: float | Column) -> Column:
    return F.floor(_c(x) / size).cast("long")


def cells_of_box(min_x, min_y, max_x, max_y, size: float | Column) -> Column:
    """Array of the grid cells (cx, cy) that a box touches."""
    ys = F.sequence(cell(min_y, size), cell(max_y, size))
    return F.flatten(F.transform(F.sequence(cell(min_x, size), cell(max_x, size)), lambda a: F.transform(ys, lambda b: F.struct(a.alias("cx"), b.alias("cy")))))


def cells_around(x, y, size: float | Column) -> Column:
    """The nine cells around a point's."""
    return F.flatten(F.transform(F.sequence(cell(x, size) - 1, cell(x, size) + 1), lambda a: F.transform(F.sequence(cell(y, size) - 1, cell(y, size) + 1), lambda b: F.struct(a.alias("cx"), b.alias("cy")))))


def segments(rings) -> Column:
    """All sides of an array of closed rings of points (x, y): structs x1, y1, x2, y2."""
    side = lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return F.flatten(F.transform(F.filter(_c(rings), lambda r: F.size(r) > 1), side))


def covered_by(x, y, rings) -> Column:
    """Whether a point lies in a polygon, its boundary (of holes too) included: ray crossings over all rings."""
    px, py, sides = _c(x), _c(y), segments(rings)
    cross = lambda s: (s["x2"] - s["x1"]) * (py - s["y1"]) - (s["y2"] - s["y1"]) * (px - s["x1"])
    on = F.exists(
        sides,
        lambda s: (cross(s) == 0) & px.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & py.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"])),
    )
    hit = lambda s: ((s["y1"] > py) != (s["y2"] > py)) & (px < F.try_divide((s["x2"] - s["x1"]) * (py - s["y1"]), s["y2"] - s["y1"]) + s["x1"])
    return on | (F.size(F.filter(sides, lambda s: F.coalesce(hit(s), F.lit(False)))) % 2 == 1)


def on_segment(px, py, ax, ay, bx, by) -> Column:
    """Nearest point of a segment in planar degrees: struct d2, x, y."""
    px, py, ax, ay, bx, by = (_c(v) for v in (px, py, ax, ay, bx, by))
    size = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(size > 0, F.least(F.greatest(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / size, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    x, y = ax + t * (bx - ax), ay + t * (by - ay)
    return F.struct(((px - x) * (px - x) + (py - y) * (py - y)).alias("d2"), x.alias("x"), y.alias("y"))


def touching(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether segments ab and cd share a point; touching counts."""
    ax, ay, bx, by, cx, cy, dx, dy = (_c(v) for v in (ax, ay, bx, by, cx, cy, dx, dy))
    turn = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    inside = lambda px, py, qx, qy, rx, ry: rx.between(F.least(px, qx), F.greatest(px, qx)) & ry.between(F.least(py, qy), F.greatest(py, qy))
    t1, t2, t3, t4 = turn(ax, ay, bx, by, cx, cy), turn(ax, ay, bx, by, dx, dy), turn(cx, cy, dx, dy, ax, ay), turn(cx, cy, dx, dy, bx, by)
    ends = ((t1 == 0) & inside(ax, ay, bx, by, cx, cy)) | ((t2 == 0) & inside(ax, ay, bx, by, dx, dy)) | ((t3 == 0) & inside(cx, cy, dx, dy, ax, ay)) | ((t4 == 0) & inside(cx, cy, dx, dy, bx, by))
    return ((t1 != t2) & (t3 != t4)) | ends


def expanded_box(min_x, min_y, max_x, max_y, margin_m: float) -> list[Column]:
    """A box with a margin in metres on all sides; none for a margin of 0 or less."""
    x1, y1, x2, y2 = (_c(v) for v in (min_x, min_y, max_x, max_y))
    if margin_m <= 0:
        return [x1, y1, x2, y2]
    dy = F.lit(float(margin_m) / DEGREE_M)
    dx = F.lit(float(margin_m)) / (F.lit(DEGREE_M) * F.greatest(F.abs(F.cos(F.radians((y1 + y2) / 2))), F.lit(0.01)))
    return [x1 - dx, y1 - dy, x2 + dx, y2 + dy]


def with_reserve(metres, kind, config: dict) -> Column:
    """Metres with sag and the technical reserve of the element kind (cto, ceo, olt; others none), to 2 digits."""
    f = config["engenharia"].get("fisica", {})
    k, extra = (F.lit(kind) if isinstance(kind, str) else kind), F.lit(0.0)
    for name, default in (("cto", 10.0), ("ceo", 30.0), ("olt", 50.0)):
        extra = F.when(k == name, F.lit(float(f.get(f"reserva_tecnica_{name}_metros", default)))).otherwise(extra)
    return rounded(_c(metres) * F.lit(1 + float(f.get("margem_flecha_percentual", 0.03))) + extra, 2)
