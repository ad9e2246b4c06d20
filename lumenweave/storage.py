"""Shared storage: cutting lineage by written tables, and broadcasts behind a measurement."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of the tables that this process has written, each with the JVM's file system that holds it.
_WRITTEN: list[tuple[object, object]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in ``spark.checkpoint.dir`` or given to ``setCheckpointDir``.  Where neither is set, a
    session in one process (``local``) gets a temporary folder, and a cluster the session's warehouse: never a
    folder that only the driver's machine has.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            found = tempfile.mkdtemp(prefix="lumenweave-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lumenweave-tables"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors.

    The table is deleted by ``release`` or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _WRITTEN.append((place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables that this process has written, once no result that reads them is needed any more."""
    while _WRITTEN:
        files, place = _WRITTEN.pop()
        files.delete(place, True)


def _release_at_exit() -> None:
    try:
        release()
    except (PySparkException, OSError):  # the JVM has gone first
        pass
    except Exception as e:  # noqa: BLE001  # py4j's own errors share no base with others
        if type(e).__module__.partition(".")[0] != "py4j":
            raise


atexit.register(_release_at_exit)


def _units(value: Column, kind: T.DataType) -> Column:
    """Size of a value: 1 for a number, 1 more for every 16 characters or bytes, the sum of its parts for others."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return one + F.coalesce(F.length(value) / 16, F.lit(0)).cast("long")
    if isinstance(kind, T.StructType):
        total = one
        for f in kind.fields:
            total = total + _units(value.getField(f.name), f.dataType)
        return total
    if isinstance(kind, T.MapType):
        return _units(F.map_entries(value), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    if isinstance(kind, T.ArrayType):
        flat = kind.elementType
        if not isinstance(flat, (T.ArrayType, T.StructType, T.MapType, T.StringType, T.BinaryType)):
            return one + F.coalesce(F.size(value), F.lit(0)).cast("long")
        return one + F.coalesce(F.aggregate(value, zero, lambda a, x: a + _units(x, flat)), zero)
    return one


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A broadcast hint if a measurement shows at most ``most`` units, else ``df`` for Spark to join by a shuffle.

    A row, a number, an element of an array and 16 characters of a string are a unit each, so a million units
    stay near 30 MB.  ``df`` should be cheap to read twice (a written table).
    """
    units = F.lit(1).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            units = units + _units(F.col(f"`{f.name}`"), f.dataType) - 1
    return F.broadcast(df) if (df.agg(F.sum(units)).first()[0] or 0) <= most else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to several tasks a core, 128 at least where a key is a project.

    For grouped functions: Spark would merge their tasks by bytes, which say little about their work.
    """
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts if len(keys) > 1 else max(128, parts), *keys)


def apart(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ranges of ``key``, several to a core: no two keys with many rows share a task, as by hashes they can."""
    return df.repartitionByRange(max(128, 4 * df.sparkSession.sparkContext.defaultParallelism), key)


def together(spark: SparkSession, *steps: Callable) -> list:
    """Results of steps that don't need each other, run at the same time so that one's last tasks leave no core idle."""
    shared_dir(spark)
    with ThreadPoolExecutor(len(steps)) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(f)) for f in steps]]


def unmeasured(df: DataFrame) -> DataFrame:
    """``df`` as a side that joins by a shuffle.

    For keys and cells of large tables: Spark takes their size from compressed files, and rows that an explode
    makes don't count, so it would broadcast millions of rows through the driver.
    """
    return df.hint("merge")
