"""Buildings from Parquet: a box that prunes at the scan, WKB centroids, containment, and distinct HPs."""

from __future__ import annotations

import inspect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import wkb_centroid_udf
from ..operators.spatial import points_in_polygons


def read_buildings(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Buildings (geometry, bbox) whose boxes meet ``box``; the comparisons reach the Parquet scan."""
    rows = spark.read.parquet(path)
    if box is not None:
        x1, y1, x2, y2 = box
        rows = rows.where((F.col("bbox.xmin") <= x2) & (F.col("bbox.xmax") >= x1) & (F.col("bbox.ymin") <= y2) & (F.col("bbox.ymax") >= y1))
    return rows.select("geometry")


def centroids(buildings: DataFrame, geometry: str | Column = "geometry") -> DataFrame:
    """Centroids (lon, lat) of WKB geometries; null and malformed ones are skipped."""
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    return buildings.filter(g.isNotNull()).withColumn("_c", wkb_centroid_udf(g)).filter("_c.lon is not null").select("*", F.col("_c.lon").alias("lon"), F.col("_c.lat").alias("lat")).drop("_c")


def matched(points: DataFrame, polygons: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Points in polygons with places rounded to 6 digits after the test; a row for each polygon that covers one."""
    hits = points_in_polygons(points, polygons, keys)
    return hits.withColumn("lon", F.round("lon", 6)).withColumn("lat", F.round("lat", 6))


def counts(hits: DataFrame, by: list[str]) -> DataFrame:
    """Buildings of each polygon, not deduplicated."""
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("hp_detectados"))


def distinct_hps(hits: DataFrame, keys: list[str]) -> DataFrame:
    """HPs: distinct rounded places of each project, numbered by place."""
    from pyspark.sql import Window

    rows = hits.select(*keys, "lon", "lat").distinct()
    return rows.withColumn("hp_id", F.row_number().over(Window.partitionBy(*keys).orderBy("lon", "lat")).cast("long"))


def reader_arguments(reader, box, timeout_s: int) -> dict:
    """Keyword arguments for an injected building reader; timeouts only as far as its signature has them."""
    out = {"bbox": box}
    try:
        names = inspect.signature(reader).parameters
    except (TypeError, ValueError):
        return out
    return out | {k: timeout_s for k in ("connect_timeout", "request_timeout") if k in names}
