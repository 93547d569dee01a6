"""Feature tables in and out: headerless CSV, Parquet, aligned name lists, score files, model bundles.

A row's place in a set of files is that of its file by path, of its line within the file. Spark deals files out by size and
splits them where it likes, so neither partitions nor increasing ids are places: rows are written once with their file,
their block of it and their id, and the rows of earlier blocks are counted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import WIDTH
from ..steps import dropped, written


PLACE = ("file_", "block_", "id_")


def _lines(spark: SparkSession, reader, path: str, place: bool) -> DataFrame:
    """What the reader reads, with each line's file, block and id if its place is wanted."""
    rows = reader(path)
    seen = [F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("id_")]
    return rows.select("*", *seen) if place else rows


def read_features(spark: SparkSession, path: str, labelled: bool, width: int = WIDTH, place: bool = False) -> DataFrame:
    """(f, label): a headerless CSV of `width` doubles and, if labelled, the label last; an unlabelled file may have one too, it is dropped. place: with pos, the row's place from 0."""
    fields = [T.StructField(f"c{i}", T.DoubleType()) for i in range(width + 2)]
    rows = _lines(spark, spark.read.schema(T.StructType(fields)).option("mode", "PERMISSIVE").csv, path, place)
    values = F.array(*(f"c{i}" for i in range(width)))
    label = F.col(f"c{width}").cast("int") if labelled else F.lit(None).cast("int")
    bad = F.exists(values, lambda x: x.isNull()) | F.col(f"c{width + 1}").isNotNull()
    if labelled:
        bad = bad | F.col(f"c{width}").isNull()
    rows = rows.select(F.when(bad, F.raise_error(F.lit(f"a row isn't {width + labelled} wide"))).otherwise(values).alias("f"), label.alias("label"), *(PLACE if place else ()))
    return placed(rows) if place else rows


def write_features(features: DataFrame, path: str, csv: bool = False, width: int = WIDTH) -> None:
    """Parquet with all columns, or the headerless CSV."""
    if csv:
        label = [F.col("label").cast("double")] if "label" in features.columns else []
        features.select(*(F.col("f")[i].alias(f"c{i}") for i in range(width)), *(c.alias("label") for c in label)).write.csv(path, header=False)
    else:
        features.write.parquet(path)


def read_names(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """(path): a line each. place: with pos, the line's place from 0."""
    rows = _lines(spark, spark.read.text, path, place).withColumnRenamed("value", "path")
    return placed(rows) if place else rows


def placed(rows: DataFrame, name: str = "pos") -> DataFrame:
    """rows with file_, block_ and id_ as a written table, with their place in the file set instead.

    A block lies in one partition, where its rows' ids follow each other; blocks follow each other by path and start. What is
    counted is a row a block; Spark broadcasts it while it is small.
    """
    rows = written(rows, "places")
    whole = Window.orderBy("file_", "block_").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = rows.groupBy("file_", "block_").agg(F.count("*").alias("n_"), F.min("id_").alias("first_"))
    blocks = blocks.select("file_", "block_", "first_", F.coalesce(F.sum("n_").over(whole), F.lit(0)).alias("before_"))
    place = F.col("before_") + F.col("id_") - F.col("first_")
    return rows.join(blocks, ["file_", "block_"]).withColumn(name, place).drop(*PLACE, "first_", "before_")


def write_aligned(rows: DataFrame, order: str, features: str, names: str, name: str = "path", width: int = WIDTH, parts: tuple[int, int] | None = None) -> None:
    """The headerless CSV of f (and label) and the list of names, both in order of a unique column, so that their places agree. parts: how many files of each, by default Spark's choice."""
    rows = written(rows, "aligned")  # one set of rows for both
    in_order = lambda n: rows.repartitionByRange(n, order).sortWithinPartitions(order) if n else rows.orderBy(order)
    write_features(in_order(parts and parts[0]), features, csv=True, width=width)
    in_order(parts and parts[1]).select(name).write.text(names)
    dropped(rows)


def joined_by_position(features: DataFrame, names: DataFrame, pos: str = "pos") -> DataFrame:
    """features with the names of a separate, aligned list, both read with their places; without them (path null) if the counts differ."""
    if pos not in features.columns or pos not in names.columns:
        raise ValueError("read features and names with place=True")
    if features.count() != names.count():
        return features.drop(pos).withColumn("path", F.lit(None).cast("string"))
    return features.join(names, pos).drop(pos)


def write_scores(scored: DataFrame, path: str, truth: bool = False) -> None:
    """filename, score to 6 places, verdict (and truth and correct), with a header; names are quoted."""
    score = F.format_string("%.6f", "p").alias("score")
    columns = ["filename", F.col("y").alias("truth"), score, "verdict", (F.col("verdict") == F.when(F.col("y") == 1, "AI").otherwise("real")).alias("correct")] if truth else ["filename", score, "verdict"]
    scored.select(*columns).write.option("header", True).option("quoteAll", True).csv(path)


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def machine_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(key, text) of lines like `SCORE 0.5`; other lines are dropped."""
    keys = "SCORE|THRESHOLD|VERDICT|DIMS|NORMALISED|TOOSMALL|CSV|VISUALS|DONE"
    pattern = rf"^\s*({keys})\b[:= ]*(.*)$"
    return lines.where(F.col(value).rlike(pattern)).select(F.regexp_extract(value, pattern, 1).alias("key"), F.trim(F.regexp_extract(value, pattern, 2)).alias("text"))


def save_bundle(spark: SparkSession, path: str, model, scalars: dict, tables: dict[str, DataFrame]) -> None:
    """A fitted pipeline, its scalars (one row of JSON) and its reference tables under one path."""
    if hasattr(model, "to_json"):
        scalars = scalars | {"model_json": model.to_json()}
    else:
        model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(scalars, sort_keys=True),)], "json string").coalesce(1).write.mode("overwrite").text(f"{path}/scalars")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(spark: SparkSession, path: str, tables: tuple[str, ...] = ()) -> tuple:
    from pyspark.ml import PipelineModel

    from ..operators.boosting import HistogramModel

    scalars = json.loads(spark.read.text(f"{path}/scalars").first()[0])
    made = scalars.pop("model_json", None)
    model = HistogramModel.from_json(made) if made else PipelineModel.load(f"{path}/model")
    return model, scalars, {t: spark.read.parquet(f"{path}/{t}") for t in tables}
