"""Roads from query answers kept as JSON files, and the text of the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"


def query_text(box: tuple[float, float, float, float], timeout_s: int) -> str:
    """The road query for a box (min_lon, min_lat, max_lon, max_lat); the text lists latitudes first."""
    x1, y1, x2, y2 = box
    area = ",".join(str(v) for v in (y1, x1, y2, x2))
    ways = "\n ".join(f'way["{tag}"]({area});' for tag in ("highway", "junction"))
    return f"\n[out:json][timeout:{timeout_s}];\n({ways});\nout geom;\n"


def read_roads(spark: SparkSession, path: str, project_id: int = 0) -> DataFrame:
    """Vertices (project_id, way_id, seq, lon, lat) of ways with a highway or junction tag and two vertices or more.

    Untagged ways pass, for an answer to the query holds nothing else; a way in several files counts once.
    """
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    tagged = F.col("e.tags").isNull() | F.map_contains_key("e.tags", "highway") | F.map_contains_key("e.tags", "junction")
    rows = rows.filter(tagged & (F.size("e.geometry") >= 2)).select("e.id", "e.geometry")
    rows = rows.withColumn("id", F.coalesce("id", F.xxhash64("geometry"))).dropDuplicates(["id"])
    return rows.select(F.lit(project_id).cast("long").alias("project_id"), F.col("id").alias("way_id"), F.posexplode("geometry").alias("seq", "p")).select("project_id", "way_id", "seq", "p.lon", "p.lat")
