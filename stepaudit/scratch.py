"""Tables written in the shared folder, to cut lineage where a plan is read more than once.

A written table survives the loss of an executor, unlike a local checkpoint. The folder is
the one that the cluster names in ``spark.checkpoint.dir``; one of our own is set only where
that is unset, as in local tests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL = "file:///tmp/checkpoints/stepaudit"


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; outside local mode the cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_at = path
    return made


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that have ended.

    It does so when the driver has collected the plans that name them, which it may otherwise not do for long.
    """
    spark._jvm.System.gc()


def remove(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`written` returned; others are left alone.

    No plan that is still to run may read them.
    """
    for df in tables:
        if at := getattr(df, "_written_at", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
