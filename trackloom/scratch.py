"""Tables that a plan leaves behind on its way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, in local mode only, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='trackloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/trackloom"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back.  Its lineage ends there, and Spark knows its size, so that a small table is broadcast in a
    join by Spark's own threshold and a large one is not."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table of ``written`` that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(there, True)
