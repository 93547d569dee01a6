"""The driver's tables read as what the operators expect: planes, scores, measures, file records, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..steps import scratch, written  # noqa: F401

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded (and -0 made 0), so that results can be compared between engines."""
    return df.select(*(F.round(c, places).__add__(F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def query(sql: str | None = None, places: int = 6):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir), places)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


SCORED = "scored AS (SELECT l.doc_id, l.quality AS y, l.toxic, d.n_chars / (d.n_chars + 1500e0) AS p, d.source AS group_key, d.lang AS generator FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
MEASURES = "measures AS (SELECT label, name, x FROM (SELECT (l_linestatus = 'O')::INT AS label, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (x FOR name IN (quantity, price, discount, tax)))"
PX = "px AS (SELECT vec_id AS img, label % 2 AS label, (p // 8)::INT AS r, (p % 8)::INT AS c, embedding[p + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS p))"
RGB = "rgb AS (SELECT vec_id AS img, (p % 3)::INT AS ch, (p // 3)::INT AS pos, embedding[p + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(63)) AS p))"
FILES = """files AS (SELECT doc_id, source || '_' || lang || CASE doc_id % 5 WHEN 1 THEN '_qhi' WHEN 2 THEN '_QLO' WHEN 3 THEN '_rweb' WHEN 4 THEN '_soft' ELSE '' END AS stem,
  CASE doc_id % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'PNG' ELSE 'jpeg' END AS ext, n_chars AS bytes, doc_id % 2 AS label, source, lang, 200 + n_chars % 700 AS width, 200 + (n_chars * 7) % 600 AS height FROM documents)"""
LOGS = "variants AS (SELECT event_type AS variant, user_id, 1 / (1 + exp(-(value - 50) / 20e0)) AS p FROM events)"


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, label, plane): each embedding as an 8 x 8 plane."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), (F.col("label") % 2).alias("label"), F.col("embedding").cast("array<double>").alias("plane"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, R, G, B): the first 63 values, every third one a channel's."""
    rows = planes(spark, sf_dir)
    pick = lambda ch: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.element_at("plane", i * 3 + ch + 1))
    return rows.select("img", pick(0).alias("R"), pick(1).alias("G"), pick(2).alias("B"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, toxic, p, group_key, generator): a score that grows with length, against the quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + F.lit(1500.0))).alias("p"), F.col("source").alias("group_key"), F.col("lang").alias("generator"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), "toxic").join(docs, "doc_id")


MEASURE_NAMES = ["quantity", "price", "discount", "tax"]


def measures_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, generator, quantity, price, discount, tax): line items, open ones as class 1."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_linestatus") == "O").cast("int").alias("label"), F.col("l_returnflag").alias("generator"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.stats import melted

    return melted(measures_wide(spark, sf_dir), ["label"], MEASURE_NAMES)


def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, stem, ext, bytes, label, source, lang, width, height): documents as image files."""
    d = F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, ("", "_qhi", "_QLO", "_rweb", "_soft"))), (d % 5 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, ("jpg", "PNG", "jpeg"))), (d % 3 + 1).cast("int"))
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("_"), "lang", suffix).alias("stem"), ext.alias("ext"), n.alias("bytes"), (d % 2).alias("label"), "source", "lang", (200 + n % 700).alias("width"), (200 + (n * 7) % 600).alias("height"))


def variant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, user_id, p): events as scores of edited copies, `view` as the control."""
    p: Column = 1 / (1 + F.exp(-(F.col("value") - 50) / F.lit(20.0)))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("variant"), "user_id", p.alias("p"))
