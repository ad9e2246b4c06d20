"""Cache of counted HPs: tables by project with versions, a geometry hash and an expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import wkb_udf

SCHEMA_VERSION = 2


def geometry_hash(polygons: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 over each project's sorted WKB texts, whatever the polygons are called."""
    rows = polygons.withColumn("_w", F.hex(wkb_udf("rings")))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_w")), "|"), 256).alias("geometry_hash"))


def reasons(version: str, now: Column | None = None) -> Column:
    """Array of reasons why a cache row (schema_version, cache_version, geometry_hash, expires_at, current_hash) is stale.

    A time without a zone is UTC; a time that can't be read, or that is now, has expired.
    """
    now = F.current_timestamp() if now is None else now
    until = F.try_to_timestamp(F.col("expires_at").cast("string"))
    checks = [
        (~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), "schema"),
        (~F.col("cache_version").cast("string").eqNullSafe(F.lit(str(version))), "versão"),
        (~F.col("geometry_hash").eqNullSafe(F.col("current_hash")), "geometria"),
        (F.coalesce(until <= now, F.lit(True)), "expiração"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]))


def save(points: DataFrame, hashes: DataFrame, path: str, config: dict) -> None:
    """Writes points (project_id, lon, lat) and metadata; only the projects that are written change."""
    days = int(config["cache"]["expirar_dias"])
    meta = hashes.select(
        "project_id", "geometry_hash", F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(str(config["cache"]["versao"])).alias("cache_version"),
        F.current_timestamp().alias("created_at"), (F.current_timestamp() + F.make_dt_interval(F.lit(days))).alias("expires_at"),
    )
    for df, name in ((points, "points"), (meta, "metadata")):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, hashes: DataFrame, config: dict, now: Column | None = None) -> DataFrame:
    """Cached points of the projects (project_id, geometry_hash) whose cache is fresh; others have no rows."""
    meta = spark.read.parquet(f"{path}/metadata").withColumn("project_id", F.col("project_id").cast("long"))
    current = hashes.select(F.col("project_id").cast("long").alias("project_id"), F.col("geometry_hash").alias("current_hash"))
    fresh = meta.join(current, "project_id").filter(F.size(reasons(config["cache"]["versao"], now)) == 0).select("project_id")
    points = spark.read.parquet(f"{path}/points").withColumn("project_id", F.col("project_id").cast("long"))
    return points.join(fresh, "project_id", "left_semi")
