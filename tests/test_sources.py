import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenweave.sources import buildings, cache, files, kml, roads

BOX = lambda x, y, d: f"{x},{y},0 {x + d},{y},0 {x + d},{y + d},0 {x},{y + d},0 {x},{y},0"
RING = lambda side, t: f"<{side}><LinearRing><coordinates>{t}</coordinates></LinearRing></{side}>"
TWO = f"""<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder>
<Placemark><name>Area</name><MultiGeometry><Polygon>{RING("outerBoundaryIs", BOX(-44.40, -2.60, 0.1))}</Polygon>
<Polygon>{RING("outerBoundaryIs", BOX(-44.20, -2.40, 0.1))}{RING("innerBoundaryIs", BOX(-44.18, -2.38, 0.02))}</Polygon></MultiGeometry></Placemark>
<Placemark><name>CTO 01</name><Point><coordinates>-44.3,-2.5,0</coordinates></Point></Placemark>
<Placemark><Point><coordinates>1,1</coordinates></Point></Placemark></Folder></Document></kml>"""


def test_polygons_and_points(spark, tmp_path):
    (tmp_path / "a.kml").write_text(TWO)
    with zipfile.ZipFile(tmp_path / "b.kmz", "w") as z:
        z.writestr("other.kml", "<kml/>")
        z.writestr("sub/doc.kml", TWO)
    got = kml.read_polygons(spark, str(tmp_path)).collect()
    assert len(got) == 4 and {r.nome for r in got} == {"Area #1", "Area #2"} and {len(r.rings) for r in got} == {1, 2} and all(r.valid for r in got)
    box = kml.box_of(kml.read_polygons(spark, str(tmp_path / "a.kml")), ["path"]).first()
    assert (box.min_x, box.min_y) == (-44.40, -2.60) and box.max_x == pytest.approx(-44.1)
    assert [(r.nome, r.lon, r.lat) for r in kml.read_points(spark, str(tmp_path / "a.kml")).collect()] == [("CTO 01", -44.3, -2.5)]
    assert kml.read_placemarks(spark, str(tmp_path / "a.kml")).filter("Point is not null").count() == 2
    assert files.box_names(spark.createDataFrame([("cto 1",), ("CEO",), ("x_ss2",)], "nome string")).count() == 2


def test_bad_files(spark, tmp_path):
    for name, data in (("a.kml", b"<kml"), ("b.kmz", b"zip"), ("c.txt", b"")):
        with pytest.raises(ValueError):
            kml.xml_of(name, data)
    (tmp_path / "a.kml").write_text("<kml")
    assert kml.read_points(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="bad XML"):
        kml.read_polygons(spark, str(tmp_path)).collect()


def test_coordinate_texts(spark):
    texts = ["1,2,3 4,5", " 1,2\n\t-3.5,4e1 ", "a,b 1,2 7", "", None, "1d,2 1_0,2", "1,2,"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(kml.coordinates_column(F.col("t")).alias("c"))
    got = [[(p.lon, p.lat) for p in r.c] for r in df.collect()]
    assert got == [kml.coordinates(t) for t in texts]
    assert got[2] == [(1.0, 2.0)] and got[5] == [(10.0, 2.0)]


def test_layers_escape(spark):
    rows = spark.createDataFrame([(1, 1, "A & <b>", 1.5, -2.0, "x\ny")], "project_id long, id int, nome string, lon double, lat double, descricao string")
    text = kml.point_layer(rows, "P", ["project_id"]).first().kml
    root = kml.xml_of("a.kml", text.encode())
    assert kml.points_of(root) == [("A & <b>", -2.0, 1.5)] and "<description>x\ny</description>" in text
    line = rows.withColumn("path", F.array(F.struct(F.lit(0.0).alias("lon"), F.lit(1.0).alias("lat")), F.struct(F.lit(2.0).alias("lon"), F.lit(3.0).alias("lat"))))
    assert "0.0,1.0,0 2.0,3.0,0" in kml.line_layer(line, "L", ["project_id"], "id").first().kml


def test_file_choice(tmp_path):
    c = {"entrada": {}}
    with pytest.raises(FileNotFoundError):
        files.project_file(tmp_path, c)
    for n in ("Area.kml", "Area Corrigida.kml", "Postes.kmz"):
        (tmp_path / n).touch()
    assert files.project_file(tmp_path, c).name == "Area.kml"
    assert files.correction_file(tmp_path, c).name == "Area Corrigida.kml"
    assert files.pole_file(tmp_path, c).name == "Postes.kmz"
    (tmp_path / "B.kml").touch()
    with pytest.raises(ValueError):
        files.project_file(tmp_path, c)
    assert files.project_file(tmp_path, {"entrada": {"arquivo_projeto": "B.kml"}}).name == "B.kml"
    with pytest.raises(FileNotFoundError):
        files.pole_file(tmp_path, {"entrada": {"arquivo_postes": "none.kml"}})
    (tmp_path / "x.txt").touch()
    with pytest.raises(ValueError):
        files.correction_file(tmp_path, {"entrada": {"arquivo_correcoes": "x.txt"}})


def test_roads(spark, tmp_path):
    way = lambda i, n, tags: {"type": "way", "id": i, "tags": tags, "geometry": [{"lat": 0.0, "lon": k * 1.0} for k in range(n)]}
    (tmp_path / "r.json").write_text(json.dumps({"elements": [way(1, 3, {"highway": "x"}), way(2, 1, {"highway": "x"}), way(3, 2, {"building": "x"}), way(4, 2, {"junction": "y"})]}))
    assert sorted((r.way_id, r.seq) for r in roads.read_roads(spark, str(tmp_path / "r.json")).collect()) == [(1, 0), (1, 1), (1, 2), (4, 0), (4, 1)]
    assert '(2.0,1.0,4.0,3.0)' in roads.query_text((1.0, 2.0, 3.0, 4.0), 60) and "[timeout:60]" in roads.query_text((1, 2, 3, 4), 60)


def test_building_reader_arguments():
    assert buildings.reader_arguments(lambda kind, bbox, connect_timeout=None, request_timeout=None: 0, (1, 2, 3, 4), 9) == {"bbox": (1, 2, 3, 4), "connect_timeout": 9, "request_timeout": 9}
    assert buildings.reader_arguments(lambda kind, bbox: 0, (1, 2, 3, 4), 9) == {"bbox": (1, 2, 3, 4)}


def test_building_scan_prunes(spark, tmp_path):
    from lumenweave.functions.shapes import to_wkb

    ring = lambda x: [[(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0), (x, 0.0)]]
    rows = [(bytearray(to_wkb(ring(float(i)))), (float(i), i + 1.0, 0.0, 1.0)) for i in range(10)] + [(None, (0.0, 1.0, 0.0, 1.0)), (bytearray(b"bad"), (0.0, 1.0, 0.0, 1.0))]
    spark.createDataFrame(rows, "geometry binary, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>").write.parquet(str(tmp_path / "b"))
    df = buildings.read_buildings(spark, str(tmp_path / "b"), (0.0, 0.0, 2.5, 1.0))
    assert "PushedFilters: [" in df._jdf.queryExecution().toString() and "bbox.xmin" in df._jdf.queryExecution().toString()
    assert sorted(r.lon for r in buildings.centroids(df).collect()) == [0.5, 1.5, 2.5]


def test_cache(spark, tmp_path):
    from lumenweave.plans.config import DEFAULT

    poly = lambda p, d: (p, [[{"x": x, "y": y} for x, y in ((0.0, 0.0), (d, 0.0), (d, d), (0.0, 0.0))]])
    schema = "project_id long, rings array<array<struct<x:double,y:double>>>"
    h = cache.geometry_hash(spark.createDataFrame([poly(1, 1.0), poly(1, 2.0), poly(2, 3.0)], schema), ["project_id"])
    again = cache.geometry_hash(spark.createDataFrame([poly(1, 2.0), poly(1, 1.0), poly(2, 3.5)], schema), ["project_id"])
    points = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.3, 0.4)], "project_id long, lon double, lat double")
    path = str(tmp_path / "c")
    cache.save(points, h, path, DEFAULT)
    assert cache.load(spark, path, h, DEFAULT).count() == 2
    assert [r.project_id for r in cache.load(spark, path, again, DEFAULT).collect()] == [1]
    late = F.current_timestamp() + F.make_dt_interval(F.lit(30), F.lit(1))
    assert cache.load(spark, path, h, DEFAULT, late).count() == 0
    cache.save(points.filter("project_id = 1").withColumn("lon", F.lit(9.0)), h.filter("project_id = 1"), path, DEFAULT)
    assert sorted(r.lon for r in cache.load(spark, path, h, DEFAULT).collect()) == [0.3, 9.0]
