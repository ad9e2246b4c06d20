import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenweave import storage


def test_written_tables_are_released(spark, monkeypatch):
    monkeypatch.setattr(storage, "_WRITTEN", [])
    df = storage.written(spark.range(5), "t")
    path = Path(storage._WRITTEN[0][1].toString().removeprefix("file:"))
    assert df.count() == 5 and path.exists()
    storage.release()
    assert not path.exists() and not storage._WRITTEN


def test_shared_folder_is_the_one_named(spark):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_broadcast_by_units(spark):
    hinted = lambda df, most: "ResolvedHint" in storage.small(df, most)._jdf.queryExecution().toString()
    assert hinted(spark.range(3), 3) and not hinted(spark.range(4), 3) and hinted(spark.range(0), 0)
    rings = spark.range(2).select("id", F.expr("array_repeat(array(0.0d, 1.0d), 50)").alias("ring"))
    assert hinted(rings, 400) and not hinted(rings, 250)
    assert not hinted(spark.range(2).select(F.lit("x" * 1600).alias("s")), 150)
    odd = spark.range(2).select(F.struct(F.lit(1).alias("a b"), F.lit("y").alias("z")).alias("a.b"), F.create_map(F.lit("k"), F.array(F.lit(b"1"))).alias("m"), F.lit(None).cast("array<string>").alias("n"))
    assert hinted(odd, 100)


def test_steps_that_need_no_other_run_at_the_same_time(spark):
    met = threading.Barrier(2, timeout=60)
    assert storage.together(spark, lambda: (met.wait(), "a")[1], lambda: (met.wait(), "b")[1]) == ["a", "b"]
    with pytest.raises(ZeroDivisionError):
        storage.together(spark, lambda: 1, lambda: 1 / 0)
