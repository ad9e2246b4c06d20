"""Domain tables from the test tables: HPs from customers, polygons from nations, streets and poles from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import unmeasured

OLT_LON, OLT_LAT = -44.295, -2.495
# One text for both engines: literals with an exponent are doubles in either.
HP_LON, HP_LAT = "-44.3e0 + (({k} * 7919) % 10007) * 1e-6", "-2.5e0 + (({k} * 104729) % 10009) * 1e-6"

POLE_LON, POLE_LAT = "-44.3e0 + (k % 14) * 4e-4 + ((k * 37) % 11) * 1e-5", "-2.5e0 + (k div 14) * 4e-4 + ((k * 53) % 13) * 1e-5"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hps(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("hp_id"), F.col("c_nationkey").cast("long").alias("project_id"), F.expr(HP_LON.format(k="c_custkey")).alias("lon"), F.expr(HP_LAT.format(k="c_custkey")).alias("lat"))


def repeated_hps(spark, sf_dir) -> DataFrame:
    """An HP for every order of a customer, so that places repeat."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("hp_id"))
    return o.join(hps(spark, sf_dir), "hp_id")


def polygons(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey").cast("double")
    x1, x2, y1, y2 = F.lit(-44.3) + n * 1e-4, F.lit(-44.29) - n * 1e-4, F.lit(-2.5) + n * 1e-4, F.lit(-2.49) - n * 1e-4
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = lambda a, b, c, d: F.array(at(a, b), at(c, b), at(c, d), at(a, d), at(a, b))
    hole = ring(F.lit(-44.296), F.lit(-2.496), F.lit(-44.294), F.lit(-2.494))
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("project_id"), F.lit(0).alias("poly_no"), F.col("n_name").alias("nome"), F.array(ring(x1, y1, x2, y2), hole).alias("rings"),
        x1.alias("min_x"), y1.alias("min_y"), x2.alias("max_x"), y2.alias("max_y"),
    )


def street_vertices(spark, sf_dir, cut: bool = False, whole: bool = False) -> DataFrame:
    """An 11 x 11 grid of streets: one way for each edge; ``cut`` drops those between columns 4 and 5.

    Ways are numbered as the SQL of one grid lists them, those from west to east first, so that a point as near to one
    as to another snaps to the same.

    It stands on the parts below 121, as the SQL has it; with ``whole`` every 121 keys of part are the grid of a project.
    """
    k, part = F.col("p_partkey").cast("long"), table(spark, sf_dir, "part")
    k, project = (k % 121, F.floor(k / 121).cast("long")) if whole else (k, F.lit(0).cast("long"))
    n = (part if whole else part.filter("p_partkey < 121")).select(project.alias("project_id"), (k % 11).alias("i"), F.floor(k / 11).cast("long").alias("j"))
    step = F.explode(F.array(F.struct((F.col("i") + 1).alias("a"), F.col("j").alias("b")), F.struct(F.col("i").alias("a"), (F.col("j") + 1).alias("b")))).alias("t")
    e = n.select("project_id", "i", "j", step).select("project_id", "i", "j", F.col("t.a").alias("a"), F.col("t.b").alias("b")).filter("a < 11 and b < 11")
    if whole:  # the last grid may have fewer nodes
        e = e.join(unmeasured(n.select("project_id", F.col("i").alias("a"), F.col("j").alias("b"))), ["project_id", "a", "b"], "left_semi")
    if cut:
        e = e.filter("not (i = 4 and a = 5)")
    ends = F.posexplode(F.array(F.struct(F.col("i").alias("x"), F.col("j").alias("y")), F.struct(F.col("a").alias("x"), F.col("b").alias("y")))).alias("seq", "v")
    node, north = F.col("j") * 11 + F.col("i"), F.col("b") - F.col("j")
    e = e.select("project_id", (1000 + node + 1000 * north).alias("way_id"), ends)
    return e.select("project_id", "way_id", "seq", (F.lit(-44.3) + F.col("v.x") * 0.001).alias("lon"), (F.lit(-2.5) + F.col("v.y") * 0.001).alias("lat"), F.col("v.x").alias("i"), F.col("v.y").alias("j"))


def poles(spark, sf_dir, whole: bool = False) -> DataFrame:
    """About 200 poles on a jittered grid, and two literal ones 59.95 m apart from south to north.

    They are the parts below 200, as the SQL has it; with ``whole`` every 200 keys of part are the poles of a project.
    """
    if whole:
        p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("pole_id"), F.floor(F.col("p_partkey") / 200).cast("long").alias("project_id"), (F.col("p_partkey") % 200).cast("long").alias("k"))
        return p.select("pole_id", F.expr(POLE_LON).alias("lon"), F.expr(POLE_LAT).alias("lat"), "project_id")
    p = table(spark, sf_dir, "part").filter("p_partkey < 200").select(F.col("p_partkey").cast("long").alias("k"))
    p = p.select(F.col("k").alias("pole_id"), F.expr(POLE_LON).alias("lon"), F.expr(POLE_LAT).alias("lat"))
    two = spark.createDataFrame([(1000, -44.2, -2.4), (1001, -44.2, -2.4 + 59.95 / 111194.92664455873)], "pole_id long, lon double, lat double")
    return p.unionByName(two).withColumn("project_id", F.lit(0).cast("long"))


def centres(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.lit(0).cast("long").alias("project_id"), F.col("s_suppkey").cast("long").alias("centre_id"), F.expr(HP_LON.replace("7919", "6151").format(k="s_suppkey")).alias("lon"), F.expr(HP_LAT.replace("104729", "15331").format(k="s_suppkey")).alias("lat"))
