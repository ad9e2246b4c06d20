"""KML and KMZ: reading polygons and points, writing layers.

Parsing runs in Arrow batches over whole files (``binaryFile``), one row per file; what comes out are tables.
"""

from __future__ import annotations

import io
import logging
import math
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import repaired
from ..operators.placement import PLAIN_COLOUR

NAMESPACE = "http://www.opengis.net/kml/2.2"
RING = "array<array<struct<x:double,y:double>>>"
POLYGON = f"path string, poly_no int, nome string, rings {RING}, min_x double, min_y double, max_x double, max_y double, valid boolean"
POINT = "path string, point_no int, nome string, lat double, lon double"
UNTITLED = "Polígono sem título"


def xml_of(name: str, data: bytes) -> ET.Element:
    """Root element of a .kml file or of the document in a .kmz archive; anything else raises ValueError."""
    suffix = name.lower().rsplit(".", 1)[-1]
    if suffix == "kmz":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                inner = sorted((n for n in z.namelist() if n.lower().endswith(".kml")), key=lambda n: (n.lower().rsplit("/", 1)[-1] != "doc.kml", n.lower()))
                if not inner:
                    raise ValueError(f"no KML in {name}")
                data = z.read(inner[0])
        except zipfile.BadZipFile as e:
            raise ValueError(f"not an archive: {name}") from e
    elif suffix != "kml":
        raise ValueError(f"neither KML nor KMZ: {name}")
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise ValueError(f"bad XML in {name}: {e}") from e


def coordinates(text: str | None) -> list[tuple[float, float]]:
    """Pairs (lon, lat) of a coordinate text; altitudes are ignored and unreadable tuples dropped."""
    out = []
    for t in (text or "").split():
        parts = t.split(",")
        try:
            out.append((float(parts[0]), float(parts[1])))
        except (ValueError, IndexError):
            continue
    return [p for p in out if all(map(math.isfinite, p))]


def coordinates_column(text: Column) -> Column:
    """The same as a column: array of (lon, lat).  Numbers follow a pattern, for casts accept more than numbers."""
    number = r"^\s*[+-]?([0-9]+(_[0-9]+)*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    value = lambda s: F.when(s.rlike(number), F.regexp_replace(s, "_", "").try_cast("double"))
    parts = F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: F.split(t, ","))
    pairs = F.transform(parts, lambda p: F.struct(value(F.get(p, F.lit(0))).alias("lon"), value(F.get(p, F.lit(1))).alias("lat")))
    return F.filter(pairs, lambda x: x["lon"].isNotNull() & x["lat"].isNotNull())


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if _local(x) == name)


def _title(mark: ET.Element) -> str:
    return next(((x.text or "").strip() for x in mark if _local(x) == "name"), "")


def polygons_of(root: ET.Element) -> list[tuple]:
    """Polygons of a document: (name, rings, valid), holes kept, repaired ones split and numbered."""
    out = []
    for mark in _all(root, "Placemark"):
        shapes = list(_all(mark, "Polygon"))
        for i, poly in enumerate(shapes, 1):
            ring = lambda side, poly=poly: [coordinates(c.text) for b in _all(poly, side) for c in _all(b, "coordinates")]
            shell, holes = ring("outerBoundaryIs"), ring("innerBoundaryIs")
            if not shell or len(shell[0]) < 3:
                continue
            rings = [r if r[0] == r[-1] else [*r, r[0]] for r in [shell[0], *(h for h in holes if len(h) >= 3)]]
            name = (_title(mark) or UNTITLED) + (f" #{i}" if len(shapes) > 1 else "")
            parts, valid = repaired(rings)
            out += [(name + (f".{k}" if len(parts) > 1 else ""), p, valid) for k, p in enumerate(parts, 1)]
    return out


def points_of(root: ET.Element) -> list[tuple[str, float, float]]:
    """Named points of a document: (name, lat, lon); the first coordinate counts."""
    out = []
    for mark in _all(root, "Placemark"):
        name, point = _title(mark), next(_all(mark, "Point"), None)
        if name and point is not None:
            at = coordinates(next((c.text for c in _all(point, "coordinates")), ""))
            if at:
                out.append((name, at[0][1], at[0][0]))
    return out


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_polygons(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """Polygons of KML or KMZ files; ``strict`` raises where a file has none or can't be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in POLYGON.split(", ")]
        for f in frames:
            rows = []
            for path, data in zip(f["path"], f["content"], strict=True):
                try:
                    found = polygons_of(xml_of(path, data))
                    if not found:
                        raise ValueError(f"no valid polygon in {path}")
                except ValueError:
                    if strict:
                        raise
                    continue
                for n, (name, rings, valid) in enumerate(found):
                    xs, ys = zip(*rings[0], strict=True)
                    rows.append((path, n, name, [[{"x": x, "y": y} for x, y in r] for r in rings], min(xs), min(ys), max(xs), max(ys), valid))
            yield pd.DataFrame(rows, columns=cols)

    return _files(spark, path).mapInPandas(run, POLYGON)


def read_points(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """Named points of KML or KMZ files; unreadable files count as empty, with a warning in the worker's log, unless ``strict``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, data in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(path, n, *p) for n, p in enumerate(points_of(xml_of(path, data)))]
                except ValueError as e:
                    if strict:
                        raise
                    logging.getLogger("lumenweave").warning("no points read from %s: %s", path, e)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in POINT.split(", ")])

    return _files(spark, path).mapInPandas(run, POINT)


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of plain KML files by Spark's XML source: name and the point's or shell's coordinate text."""
    ring = "struct<LinearRing:struct<coordinates:string>>"
    schema = f"name string, Point struct<coordinates:string>, Polygon array<struct<outerBoundaryIs:{ring},innerBoundaryIs:array<{ring}>>>"
    return spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)


def box_of(polys: DataFrame, by: list[str]) -> DataFrame:
    """Box around all polygons of each group."""
    return polys.groupBy(*by).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _element(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))


def _document(rows: DataFrame, folder: str, by: list[str], order: str) -> DataFrame:
    """One KML text for each group from rows with an ``_mark`` column."""
    body = rows.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), "_mark"))), lambda x: x["_mark"]), "").alias("_body"))
    head = f"<?xml version='1.0' encoding='utf-8'?>\n<kml xmlns=\"{NAMESPACE}\"><Document><Folder>"
    return body.select(*by, F.concat(F.lit(head), _element("name", escaped(F.lit(folder))), "_body", F.lit("</Folder></Document></kml>")).alias("kml"))


def point_layer(rows: DataFrame, folder: str, by: list[str], order: str = "id") -> DataFrame:
    """KML of points (nome, lon, lat, optional descricao and icone) in one folder for each group."""
    about = _element("description", escaped(F.col("descricao"))) if "descricao" in rows.columns else F.lit("")
    icon = _element("Style", _element("IconStyle", F.concat(F.lit("<scale>1.2</scale>"), _element("Icon", _element("href", escaped(F.col("icone"))))))) if "icone" in rows.columns else F.lit("")
    at = F.concat(F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit(",0"))
    mark = _element("Placemark", F.concat(_element("name", escaped(F.col("nome"))), F.coalesce(about, F.lit("")), F.coalesce(icon, F.lit("")), _element("Point", _element("coordinates", at))))
    return _document(rows.withColumn("_mark", mark), folder, by, order)


def line_layer(rows: DataFrame, folder: str, by: list[str], order: str = "seq", width: int = 2) -> DataFrame:
    """KML of lines (nome, path, colour, optional descricao) in one folder for each group."""
    about = _element("description", escaped(F.col("descricao"))) if "descricao" in rows.columns else F.lit("")
    colour = F.coalesce(F.col("colour"), F.lit(PLAIN_COLOUR)) if "colour" in rows.columns else F.lit(PLAIN_COLOUR)
    style = _element("Style", _element("LineStyle", F.concat(_element("color", colour), F.lit(f"<width>{width}</width>"))))
    at = F.array_join(F.transform("path", lambda p: F.concat(p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit(",0"))), " ")
    mark = _element("Placemark", F.concat(_element("name", escaped(F.col("nome"))), F.coalesce(about, F.lit("")), style, _element("LineString", F.concat(F.lit("<tessellate>1</tessellate>"), _element("coordinates", at)))))
    return _document(rows.withColumn("_mark", mark), folder, by, order)


def hp_layer(hps: DataFrame, by: list[str]) -> DataFrame:
    """KML of HPs named HP_001 on, in the order of their places."""
    from pyspark.sql import Window

    rows = hps.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("lon", "lat", "hp_id")))
    return point_layer(rows.withColumn("nome", F.format_string("HP_%03d", "_n")), "Casas", by, "_n")


def exception_layer(exceptions: DataFrame, by: list[str]) -> DataFrame:
    """KML of failed links as straight lines for reference."""
    c = F.col
    name = F.concat(F.lit("EXCECAO_"), F.format_string("%03d", "exc_no"), F.lit("_"), "status", F.lit("_"), "a_ref", F.lit("_to_"), "b_ref")
    note = F.concat(
        F.lit("LINHA DE REFERÊNCIA - NÃO É ROTA VÁLIDA\nEscopo: "), "scope", F.lit("\nStatus: "), "status", F.lit("\nTipo: "), "link", F.lit("\nOrigem: "), "a_ref", F.lit("\nDestino: "), "b_ref",
        F.lit("\nDetalhe: "), F.when(F.coalesce(c("message"), F.lit("")) == "", "rota não encontrada").otherwise(c("message")),
    )
    line = F.array(F.struct(c("o_lon").alias("lon"), c("o_lat").alias("lat")), F.struct(c("d_lon").alias("lon"), c("d_lat").alias("lat")))
    rows = exceptions.withColumn("nome", name).withColumn("descricao", note).withColumn("path", line).withColumn("colour", F.lit("ff0000ff"))
    return line_layer(rows, "Exceções de Roteamento - Referência", by, "exc_no", width=4)


def safe_name(text: str) -> str:
    return re.sub(r'[\\/:*?"<>|]', "_", text)
