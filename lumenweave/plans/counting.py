"""Counting home passed: polygons and buildings in, distinct HPs, counts, sizing and layers out, with a cache."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources import buildings, cache, kml, publish
from ..storage import written
from . import sizing

LOG = logging.getLogger("lumenweave")
#: Spark's conditions for a folder that isn't there, or has no table yet.
NO_CACHE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


@dataclass
class Count:
    """HPs (project_id, hp_id, lon, lat), counts of polygons, and sizing; projects without HPs have no sizing."""

    hps: DataFrame
    polygons: DataFrame
    sizing: DataFrame
    from_cache: bool


def count(spark: SparkSession, polygons: DataFrame, building_path: str, config: dict, cache_path: str | None = None) -> Count:
    """Counts buildings in ``polygons`` (project_id, poly_no, nome, rings, box).

    Buildings are read within the box of all polygons.  With a cache, projects that are fresh there are taken from
    it, and only the others are counted; their HPs are written to it even if there are none.
    """
    hashes = cache.geometry_hash(polygons, ["project_id"])
    known = None
    if cache_path is not None:
        try:
            known = written(cache.load(spark, cache_path, hashes, config).select("project_id", "hp_id", "lon", "lat", "poly_no", "nome"), "cached-hps")
        except AnalysisException as e:
            if e.getCondition() not in NO_CACHE:
                raise
            LOG.info("no cache yet: %s", e.getCondition())
    todo = polygons if known is None else polygons.join(known.select("project_id").distinct(), "project_id", "left_anti")
    box = todo.agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
    fresh = None
    if box[0] is not None:
        points = buildings.centroids(buildings.read_buildings(spark, building_path, tuple(box))).select("lon", "lat")
        hits = buildings.matched(points, todo)
        ids = buildings.distinct_hps(hits, ["project_id"])
        fresh = written(hits.select("project_id", "poly_no", "nome", "lon", "lat").join(ids, ["project_id", "lon", "lat"]).select("project_id", "hp_id", "lon", "lat", "poly_no", "nome"), "hps")
        if cache_path is not None:
            cache.save(fresh, hashes.join(todo.select("project_id").distinct(), "project_id", "left_semi"), cache_path, config)
    rows = known if fresh is None else fresh if known is None else known.unionByName(fresh)
    per = polygons.select("project_id", "poly_no", "nome", *[F.round(c, 8).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    found = buildings.counts(rows, ["project_id", "poly_no"])
    per = per.join(found, ["project_id", "poly_no"], "left").withColumn("hp_detectados", F.coalesce("hp_detectados", F.lit(0)))
    hps = rows.select("project_id", "hp_id", "lon", "lat").distinct()
    sized = sizing.sized(hps.groupBy("project_id").agg(F.count(F.lit(1)).alias("hp")), config)
    return Count(hps, per, sized, fresh is None)


def write(c: Count, path: str, config: dict) -> None:
    """Sizing as JSON lines and HPs as map layers, one folder for each project; other projects' folders stay."""
    for df, name in ((publish.sizing_json(c.sizing, config), "sizing"), (kml.hp_layer(c.hps, ["project_id"]), "hps")):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").text(f"{path}/{name}")


def one_route(spark: SparkSession, streets: DataFrame, origin, destination, config: dict, limit_m: float | None = None, kind: str = "distribuicao"):
    """One route over one project's streets, as a row with status, path and dist_m."""
    project = streets.select("project_id").first()
    ask = spark.createDataFrame([(project[0] if project else 0, 1, *map(float, origin), *map(float, destination), kind)], "project_id long, req_id long, o_lon double, o_lat double, d_lon double, d_lat double, kind string")
    return graph.routes(ask, graph.street_edges(streets), config, limit_m).first()


def distance(a, b) -> float:
    """Haversine metres between two points (lon, lat)."""
    return graph.metres(a, b)


