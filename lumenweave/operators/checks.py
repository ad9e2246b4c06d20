"""Checks of a given allocation: coverage, duplicates, memberships, capacities, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AllocationError(ValueError):
    """An allocation that breaks a rule."""


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys expected but not found, and found but not expected."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("unknown")))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def statistics(members: DataFrame, capacities: tuple[int, int, int]) -> DataFrame:
    """Totals, boxes over capacity and highest occupation, from memberships (hp_id, cto_id, pon_id, ceo_id)."""
    out = None
    for name, child, cap in (("cto", "hp_id", capacities[0]), ("pon", "cto_id", capacities[1]), ("ceo", "pon_id", capacities[2])):
        n = members.filter(F.col(f"{name}_id").isNotNull()).groupBy(f"{name}_id").agg(F.count_distinct(child).alias("n"))
        row = n.agg(F.count(F.lit(1)).alias(f"{name}s"), F.count_if(F.col("n") > cap).alias(f"{name}s_over"), F.coalesce(F.max("n"), F.lit(0)).alias(f"{name}_max"))
        out = row if out is None else out.crossJoin(row)  # one row each
    return out.crossJoin(members.agg(F.count_distinct("hp_id").alias("hps")))


def violations(hps: DataFrame, ctos: DataFrame, pons: DataFrame, ceos: DataFrame, capacities: tuple[int, int, int]) -> DataFrame:
    """One row per violated rule: rule, id.

    ``hps``: hp_id; ``ctos``: cto_id, hp_ids; ``pons``: pon_id, cto_ids; ``ceos``: ceo_id, pon_ids.
    """
    rows = []
    for name, table, child, parent, cap in (("cto", ctos, hps.select(F.col("hp_id").alias("child")), "hp", capacities[0]), ("pon", pons, ctos.select(F.col("cto_id").alias("child")), "cto", capacities[1]), ("ceo", ceos, pons.select(F.col("pon_id").alias("child")), "pon", capacities[2])):
        key, member = f"{name}_id", table.select(F.explode(f"{parent}_ids").alias("child"))
        tag = lambda df, col, rule: df.select(F.lit(rule).alias("rule"), F.col(col).cast("string").alias("id"))
        rows += [
            tag(duplicates(table, key), key, f"{name}_id_repeated"),
            tag(table.filter(F.size(f"{parent}_ids") > cap), key, f"{name}_over_capacity"),
            tag(duplicates(member, "child"), "child", f"{parent}_in_several"),
            tag(child.distinct().join(member, "child", "left_anti"), "child", f"{parent}_in_none"),
            tag(member.distinct().join(child, "child", "left_anti"), "child", f"{parent}_unknown"),
        ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def require_valid(*args) -> None:
    bad = violations(*args).limit(5).collect()
    if bad:
        raise AllocationError("; ".join(f"{r['rule']}: {r['id']}" for r in bad))


def recount_mismatch(members: DataFrame, config: dict) -> DataFrame:
    """Projects whose PONs or splice boxes are not the fewest for their boxes, from ``clusters.hierarchy`` rows."""
    e = config["engenharia"]
    rows = members.groupBy("project_id").agg(F.count_distinct("cto").alias("ctos"), F.count_distinct("pon").alias("pons"), F.count_distinct("ceo").alias("ceos"))
    rows = rows.withColumn("least_pons", F.ceil(F.col("ctos") / int(e["ctos_por_pon"])).cast("long"))
    rows = rows.withColumn("least_ceos", F.ceil(F.col("least_pons") / int(e["pons_por_ceo"])).cast("long"))
    return rows.filter((F.col("pons") != F.col("least_pons")) | (F.col("ceos") != F.col("least_ceos")))
