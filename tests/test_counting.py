import json

import pytest

from lumenweave.functions.shapes import to_wkb
from lumenweave.plans import counting
from lumenweave.plans.config import DEFAULT
from lumenweave.sources import kml

BOX = lambda x, y, d: f"{x},{y} {x + d},{y} {x + d},{y + d} {x},{y + d} {x},{y}"


def test_from_files_to_sizing(spark, tmp_path):
    mark = lambda n, x: f"<Placemark><name>{n}</name><Polygon><outerBoundaryIs><LinearRing><coordinates>{BOX(x, 0.0, 0.01)}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
    (tmp_path / "p.kml").write_text(f"<kml><Document>{mark('A', 0.0)}{mark('B', 0.005)}{mark('C', 0.05)}</Document></kml>")
    ring = lambda x: [[(x, 0.001), (x + 1e-4, 0.001), (x + 1e-4, 0.0011), (x, 0.0011), (x, 0.001)]]
    xs = [0.0005 * i for i in range(25)] + [0.0, 0.2]
    rows = [(bytearray(to_wkb(ring(x))), (x, x + 1e-4, 0.001, 0.0011)) for x in xs]
    spark.createDataFrame(rows, "geometry binary, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>").write.parquet(str(tmp_path / "b"))
    polys = kml.read_polygons(spark, str(tmp_path / "p.kml")).selectExpr("1L as project_id", "poly_no", "nome", "rings", "min_x", "min_y", "max_x", "max_y")
    c = counting.count(spark, polys, str(tmp_path / "b"), DEFAULT, str(tmp_path / "cache"))
    inside = lambda lo: sum(lo <= x + 5e-5 <= lo + 0.01 for x in xs)
    assert {r.nome: r.hp_detectados for r in c.polygons.collect()} == {"A": inside(0.0), "B": inside(0.005), "C": 0}
    hp = len({round(x, 6) for x in xs if -1e-9 <= x + 5e-5 <= 0.015})
    assert c.hps.count() == hp and [(r.hp, r.ctos) for r in c.sizing.collect()] == [(hp, -(-hp // 16))] and not c.from_cache
    again = counting.count(spark, polys, str(tmp_path / "none"), DEFAULT, str(tmp_path / "cache"))
    assert again.from_cache and sorted(map(tuple, again.hps.collect())) == sorted(map(tuple, c.hps.collect()))
    assert sorted(map(tuple, again.polygons.collect())) == sorted(map(tuple, c.polygons.collect()))
    counting.write(c, str(tmp_path / "out"), DEFAULT)
    text = next((tmp_path / "out/sizing/project_id=1").glob("part*")).read_text()
    assert json.loads(text)["dimensionamento"]["regra_cto"] == "cobertura_hp"


def test_projects_are_written_side_by_side(spark, tmp_path):
    sized = lambda n: spark.createDataFrame([(n, 20)], "project_id long, hp long")
    for n in (1, 2, 1):
        hps = spark.createDataFrame([(n, 1, 0.0, 0.0)], "project_id long, hp_id long, lon double, lat double")
        counting.write(counting.Count(hps, hps, counting.sizing.sized(sized(n), DEFAULT), False), str(tmp_path), DEFAULT)
    assert sorted(x.name for x in (tmp_path / "sizing").glob("project*")) == sorted(x.name for x in (tmp_path / "hps").glob("project*")) == ["project_id=1", "project_id=2"]


def test_a_broken_cache_is_not_taken_for_none(spark, tmp_path):
    (tmp_path / "cache/metadata").mkdir(parents=True)
    (tmp_path / "cache/metadata/part.parquet").write_text("not a table")
    polys = spark.createDataFrame([(1, 1, "A", [[[0.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0]]], 0.0, 0.0, 1.0, 1.0)], "project_id long, poly_no long, nome string, rings array<array<array<double>>>, min_x double, min_y double, max_x double, max_y double")
    with pytest.raises(Exception, match="(?i)parquet|footer|magic"):
        counting.count(spark, polys, str(tmp_path / "none"), DEFAULT, str(tmp_path / "cache"))


def test_one_route(spark):
    s = spark.createDataFrame([(1, 1, i, i * 0.001, 0.0) for i in range(3)], "project_id long, way_id long, seq int, lon double, lat double")
    r = counting.one_route(spark, s, (0.0, 0.0), (0.002, 0.0), DEFAULT)
    assert r.status == "OK" and r.dist_m == pytest.approx(229.06)
    assert counting.one_route(spark, s.limit(0), (0.0, 0.0), (0.002, 0.0), DEFAULT).status == "SEM_MALHA"
    assert counting.distance((0.0, 0.0), (0.001, 0.0)) == pytest.approx(111.19, abs=0.01)
