"""Mixing sources to target weights by capped water-filling.

Each source is an urn that holds at most ``max_epochs`` times its own words.  The total is poured
over the sources in proportion to their weights; what overflows a full urn is poured again over the
others, until none is above its cap.  The targets follow from one sort of the source table: by words
per weight, the full urns are a prefix.  A source's documents are then taken ``floor(target / size)``
times, and a seeded fraction of them once more: documents fall into 4,096 hash buckets per source,
and the prefix of buckets whose words come nearest to what is missing is taken again.

Only sums per source and bucket are shuffled, never texts.  The source table has one row for each
distinct source; its global windows are the only single-task step and see nothing else.

Defined cases: null text has size 0; a null source is a source of its own, last in order; repeated
rows share a bucket and are taken alike; an empty table gives an empty table; helper columns carry a
reserved prefix, so extra columns of any other name pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, broadcast_if_small, save, word_count

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: A source table of more rows is joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 50_000


def bucket(doc_id: Column, text: Column, seed: str) -> Column:
    """One of 4,096 buckets, from three hexadecimal digits of a seeded MD5."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(seed), doc_id.cast("string"), text)), 1, 3)


def source_plan(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per source: words, target, whole copies, last bucket of the extra copy (null: none)."""
    sums = save(
        docs.select(F.col("source").alias(P + "source"), bucket(F.col("doc_id"), F.col("text"), seed).alias(P + "bucket"), word_count(F.col("text")).alias(P + "n"))
        .groupBy(P + "source", P + "bucket").agg(F.sum(P + "n").alias(P + "n")),
        "mix-sums",
    )
    by_order, by_fill = Window.orderBy(F.col(P + "source").asc_nulls_last()), Window.orderBy(F.col(P + "size") / F.col(P + "w"), F.col(P + "source").asc_nulls_last())
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), ((F.row_number().over(by_order) - 1) % len(weights) + 1).cast("int"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = (
        sums.groupBy(P + "source").agg(F.sum(P + "n").alias(P + "size"))
        .withColumn(P + "w", weight)
        .withColumn(P + "cap", F.col(P + "size") * max_epochs)
        .withColumn(P + "left", F.sum(P + "size").over(every) - F.coalesce(F.sum(P + "cap").over(before), F.lit(0)))
        .withColumn(P + "w_left", F.sum(P + "w").over(after))
        .withColumn(P + "full", F.col(P + "cap") * F.col(P + "w_left") <= F.col(P + "w") * F.col(P + "left"))
        .withColumn(P + "full", F.min(P + "full").over(by_fill.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(P + "rest", F.sum(P + "size").over(every) - F.sum(F.when(F.col(P + "full"), F.col(P + "cap")).otherwise(0)).over(every))
        .withColumn(P + "w_rest", F.sum(F.when(F.col(P + "full"), 0).otherwise(F.col(P + "w"))).over(every))
    )
    target = F.when(F.col(P + "full"), F.col(P + "cap").cast("double")).otherwise((F.col(P + "w") * F.col(P + "rest")).cast("double") / F.col(P + "w_rest"))
    plan = full.select(P + "source", P + "size", target.alias(P + "target")).withColumn(
        P + "whole", F.when(F.col(P + "size") > 0, F.floor(F.col(P + "target") / F.col(P + "size"))).otherwise(0).cast("long")
    )
    need = F.col(P + "target") - (F.col(P + "whole") * F.col(P + "size")).cast("double")
    run = F.sum(P + "n").over(Window.partitionBy(P + "source").orderBy(P + "bucket"))
    cut = (
        sums.withColumn(P + "run", run)
        .join(plan.select(F.col(P + "source").alias(P + "s"), need.alias(P + "need")), F.col(P + "source").eqNullSafe(F.col(P + "s")))
        .withColumn(P + "gap", F.abs(F.col(P + "run") - F.col(P + "need")))
        .filter(F.col(P + "gap") < F.col(P + "need"))
        .groupBy(P + "s").agg(F.min_by(P + "bucket", F.struct(P + "gap", P + "bucket")).alias(P + "cut"))
    )
    return plan.join(cut, F.col(P + "source").eqNullSafe(F.col(P + "s")), "left").drop(P + "s")


def with_copies(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` with helper columns: times taken (``_lw_copies``), the source's words and target."""
    plan = save(source_plan(docs, weights, max_epochs, seed), "mix-plan")
    joined = docs.join(broadcast_if_small(plan, BROADCAST_SOURCES), docs["source"].eqNullSafe(plan[P + "source"]))
    again = F.coalesce(bucket(docs["doc_id"], docs["text"], seed) <= F.col(P + "cut"), F.lit(False))
    return joined.withColumn(P + "copies", F.col(P + "whole") + again.cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns of ``docs``."""
    taken = with_copies(docs, weights, max_epochs, seed).filter(F.col(P + "copies") > 0)
    names = [docs[c] for c in docs.columns]
    return taken.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col(P + "copies"))).alias(P + "copy")).select(*docs.columns)


def mix_report(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Per document: its size, its source's words and target, and the words that the mix takes."""
    rows = with_copies(docs.select("doc_id", "text", "source"), weights, max_epochs, seed)
    return rows.select("doc_id", word_count(F.col("text")).alias("size"), F.col(P + "size").alias("source_size"), F.col(P + "target").alias("target"), F.col(P + "copies").alias("copies")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  substr(md5(concat_ws('|', 'mix-1', doc_id::VARCHAR, text)), 1, 3) AS b FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
             sum(w) OVER (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
g AS (SELECT *, bool_and(3 * source_size * w_left <= w * (total - used)) OVER (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) AS at_cap FROM f),
h AS (SELECT *, total - sum(CASE WHEN at_cap THEN 3 * source_size ELSE 0 END) OVER () AS rest, sum(CASE WHEN at_cap THEN 0 ELSE w END) OVER () AS w_rest FROM g),
t AS (SELECT source, source_size, CASE WHEN at_cap THEN (3 * source_size)::DOUBLE ELSE (w * rest)::DOUBLE / w_rest::DOUBLE END AS target FROM h),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT source, b, sum(n) OVER (PARTITION BY source ORDER BY b) AS run FROM (SELECT source, b, sum(size) AS n FROM d GROUP BY source, b)),
c AS (SELECT u.source, r.b, abs(r.run::DOUBLE - (u.target - (u.whole * u.source_size)::DOUBLE)) AS gap, u.target - (u.whole * u.source_size)::DOUBLE AS need
      FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source),
k AS (SELECT source, b AS cut FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY gap, b) AS i FROM c WHERE gap < need) WHERE i = 1)
SELECT d.doc_id, d.size, u.source_size, u.target, (d.size * (u.whole + CASE WHEN d.b <= k.cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source LEFT JOIN k ON k.source IS NOT DISTINCT FROM d.source
"""
