"""Publishing a plan: map layers and reports by project.  Layers that are empty now replace older ones."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.placement import OLT_ICON
from ..plans.network import Plan, report
from ..plans.sizing import report_map
from ..storage import written
from . import kml

LOG = logging.getLogger("lumenweave")


def layers(p: Plan) -> DataFrame:
    """All layers of all projects: project_id, layer, kml.  A layer without content has no row."""
    by = ["project_id"]
    of_cables = lambda scope: p.cables.filter(F.col("scope") == scope)
    made = {
        "ctos": kml.point_layer(p.ctos, "CTOs Posicionadas", by, "cto_no"),
        "ceos": kml.point_layer(p.ceos, "CEOs Posicionadas", by, "ceo_ord"),
        "olt": kml.point_layer(p.olts.withColumn("icone", F.lit(OLT_ICON)).withColumn("descricao", F.format_string("ID interno: %s\nCoordenada configurada: %.7f, %.7f", "id", "raw_lat", "raw_lon")), "OLT", by),
        "distribuicao": kml.line_layer(of_cables("distribuicao"), "Cabos de Distribuição", by),
        "backbone": kml.line_layer(of_cables("backbone"), "Cabos de Backbone e Feeder", by),
        "excecoes": kml.exception_layer(p.exceptions, by),
        "casas": kml.hp_layer(p.hps.filter("hp_id is not null"), by),
    }
    out = None
    for name, df in made.items():
        df = df.select("project_id", F.lit(name).alias("layer"), "kml")
        out = df if out is None else out.unionByName(df)
    return out


def _drop_stale(made: DataFrame, projects: DataFrame, path: str) -> None:
    """Deletes the layer folders of ``projects`` that are not among the layers ``made``."""
    spark = made.sparkSession
    there = spark.read.text(path).select(F.col("project_id").cast("string").alias("project_id"), "layer").distinct()
    named = lambda df: df.select(F.col("project_id").cast("string").alias("project_id"), *[c for c in df.columns if c == "layer"]).distinct()
    stale = there.join(named(projects), "project_id", "left_semi").join(named(made), ["project_id", "layer"], "left_anti")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for r in stale.collect():  # folders that are gone since the last publishing
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/project_id={r['project_id']}/layer={r['layer']}")
        place.getFileSystem(conf).delete(place, True)


def publish(p: Plan, path: str) -> None:
    """Writes layers as text and reports as JSON lines under ``path``, one folder for each project and layer.

    The projects of this plan are replaced as a whole, so their stale layers (an OLT, backbone or exceptions that are
    gone) vanish; other projects under ``path`` stay as they are.
    """
    made, reports = written(layers(p), "layers"), written(report(p), "reports")
    alone = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    alone(made).partitionBy("project_id", "layer").option("lineSep", "\n").text(f"{path}/layers")
    alone(reports).partitionBy("project_id").json(f"{path}/reports")
    if made.limit(1).count():
        _drop_stale(made.select("project_id", "layer"), reports.select("project_id"), f"{path}/layers")
    LOG.info("published to %s", path)


def sizing_json(sized: DataFrame, config: dict) -> DataFrame:
    """Sizing results as JSON text for each project."""
    block = F.struct(*[c.alias(k) for k, c in report_map(config["engenharia"]).items()])
    return sized.select("project_id", F.to_json(F.struct("hp", "hc", "ctos", "pons", "ceos", block.alias("dimensionamento"))).alias("json"))
