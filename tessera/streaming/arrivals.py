"""An extension, nothing the reference has: images that arrive in a folder are measured and scored as a stream.

The same vectorised function as in batch runs on each micro-batch; files are taken once, by the stream's
checkpoint, so a restart neither repeats nor skips any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import metrics, names

_FIELDS = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """A stream of image files: path, size, modified, content."""
    files = spark.readStream.format("binaryFile").schema(_FIELDS).option("maxFilesPerTrigger", most_files).load(folder)
    files = files.where(names.extension_of(F.col("path")).isin("jpg", "jpeg", "png"))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def arriving_features(spark: SparkSession, folder: str, schema: str, most_files: int = 100) -> DataFrame:
    """A stream of measured rows from Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def judged(stream: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """The stream with verdict and strength; no state."""
    return stream.withColumns({"verdict": metrics.verdict(F.col(p), threshold), "strength": metrics.strength(F.col(p), threshold)})


def hourly_share(stream: DataFrame, threshold: float, time: str = "modified", late: str = "2 hours", p: str = "p") -> DataFrame:
    """Flagged share of each hour; rows later than the watermark are dropped with the hour's state."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, "1 hour"))
    return rows.agg(F.count("*").alias("n"), F.avg((F.col(p) >= threshold).cast("double")).alias("share"))


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, then stop; call again for what comes later."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
