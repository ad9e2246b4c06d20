"""What the operators of this subpackage share: words and row keys, beside the library's storage and size checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import small as broadcast_if_small
from ..storage import written as save

__all__ = ["P", "WORD", "broadcast_if_small", "row_key", "save", "table", "with_nodes", "word_count"]

#: A word: a maximal run of anything but ASCII white space (Java, Python and RE2 syntax alike).
WORD = r"[^\x20\x09-\x0D]+"
#: Prefix of every helper column, so that columns of the input never clash with ours.
P = "_lw_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of a row's content.  Rows with equal id and text share it, and every operator gives them equal results."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.xxhash64(text, F.lit(7)).cast("string"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_nodes(docs: DataFrame) -> DataFrame:
    """Adds the node of each row's text: a 64-bit hash, moved for texts that collide with another."""
    one, two = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    rows = docs.withColumn(P + "t", F.when(F.col("text").isNotNull(), one))
    slim = rows.filter(F.col("text").isNotNull()).select(F.col(P + "t").alias(P + "ct"), two.alias(P + "two"))
    clash = slim.groupBy(P + "ct").agg(F.min(P + "two").alias(P + "lo"), F.max(P + "two").alias(P + "hi")).filter(F.col(P + "lo") != F.col(P + "hi")).select(P + "ct")
    clash = save(clash, "collisions")
    if clash.limit(1).count() == 0:
        return rows
    joined = rows.join(broadcast_if_small(clash, 300_000), F.col(P + "t") == F.col(P + "ct"), "left")
    return joined.withColumn(P + "t", F.when(F.col(P + "ct").isNotNull(), F.xxhash64(P + "t", two)).otherwise(F.col(P + "t"))).drop(P + "ct")
