"""Steps written as tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, step: str) -> str:
    """A new path in the folder in spark.checkpoint.dir. Where that is unset an error on a cluster, a temporary folder on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera-{step}-{uuid.uuid4().hex}"


def written(df: DataFrame, step: str, *by: str) -> DataFrame:
    """df as a Parquet table: what follows reads it as often as it likes, and a lost executor costs its tasks only. by: columns that make folders."""
    path = scratch(df.sparkSession, step)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def dropped(*steps: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    for df in steps:
        path = getattr(df, "_tessera_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
