"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='trackloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What ``keep`` has written since ``settled`` began, for each call of it that is open in this thread.
_WRITTEN: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later steps neither recompute it nor depend
    on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trackloom/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    for written in _WRITTEN.get()[-1:]:
        written.append(path)
    return spark.read.schema(schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """What ``make`` gives, kept, and its folder; the tables that ``keep`` wrote on the way are removed.  Nothing made within may be read
    afterwards but the result."""
    paths: list[str] = []
    outer = _WRITTEN.set((*_WRITTEN.get(), paths))
    try:
        out = keep(make(), name)
        folder = paths.pop()
    finally:
        _WRITTEN.reset(outer)
        for path in paths:
            removed(spark, path)
    return out, folder


def removed(spark: SparkSession, path: str) -> bool:
    """Delete a folder of the shared store, if it is there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def summed_before(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, chunk: int = 4096) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same keys that come before, by ``order``, a whole number
    that does not repeat within the keys.  Rows are summed up in chunks of the order and the chunks' sums in a second
    step, so a key's rows are never in one task.  ``df`` is read twice: keep it first."""
    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_held"))
    starts = sums.select(*keys, "_chunk", F.coalesce(F.sum("_held").over(before(*keys).orderBy("_chunk")), F.lit(0)).alias("_start"))
    own = F.coalesce(F.sum(value).over(before(*keys, "_chunk").orderBy(order)), F.lit(0))
    return df.withColumn("_own", own).join(starts, [*keys, "_chunk"]).withColumn(name, F.col("_own") + F.col("_start")).drop("_chunk", "_own", "_start")
