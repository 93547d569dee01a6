"""What the operators of this subpackage share: reading tables, the shared scratch folder, written steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder all executors share: the one in spark.checkpoint.dir; where that is unset, on one machine only, a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, step: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{scratch(df.sparkSession)}/tessera-{step}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """What is written meanwhile hands Python at most so many rows at a time: long texts at Spark's 10,000 take some 100 MB of a task in the executor and its worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(rows, before) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def dropped(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores added until no column of df has it (in any case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def plus(df: DataFrame, **more: T.DataType) -> T.StructType:
    """df's schema with further fields."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in more.items())])


def others(df: DataFrame, used: tuple[str, ...], made: tuple[str, ...]) -> list[str]:
    """The columns of df that an operator hands on: not those it uses, nor any with a name it gives to a result, which replaces it."""
    gone = {c.lower() for c in (*used, *made)}
    return [c for c in df.columns if c.lower() not in gone]
