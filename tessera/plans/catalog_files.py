"""Queries: what goes through files and comes back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import images, tables, trees
from . import bindings as b
from .bindings import FILES, query
from .catalog_models import made_images
from .catalog_stats import R6


@query(f"""SELECT 'img_' || vec_id || CASE WHEN label % 2 = 1 THEN '_gen.png' ELSE '_cam.png' END AS path, (label % 2)::INT AS label, {R6('embedding[1]::DOUBLE')} AS first, {R6('embedding[64]::DOUBLE')} AS last,
{R6('list_sum(list_transform(embedding, lambda x: x::DOUBLE))')} AS total FROM embeddings""")
def aligned_names(spark, sf_dir):
    """A headerless feature CSV and an aligned list of names, written in several part files each, and joined again by place."""
    rows = b.planes(spark, sf_dir).select("img", F.col("plane").alias("f"), F.col("label").cast("int").alias("label"))
    rows = rows.withColumn("path", F.concat(F.lit("img_"), F.col("img").cast("string"), F.when(F.col("label") == 1, "_gen.png").otherwise("_cam.png")))
    features, names = b.scratch(spark, "features"), b.scratch(spark, "names")
    tables.write_aligned(rows, "img", features, names, width=64, parts=(7, 3))
    back = tables.joined_by_position(tables.read_features(spark, features, labelled=True, width=64, place=True), tables.read_names(spark, names, place=True))
    return back.select("path", "label", F.col("f")[0].alias("first"), F.col("f")[63].alias("last"), F.aggregate("f", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("SELECT count(*) AS files, true AS same, 0::BIGINT AS left_over, count(*) AS read_back FROM embeddings")
def png_tree(spark, sf_dir):
    """(files, same, left_over, read_back): images written as a tree of PNG files and read back; how many a second run would write."""
    rows = made_images(spark, sf_dir, 32).withColumn("target", F.regexp_replace("path", r"\.png$", ""))
    folder = b.scratch(spark, "tree")
    trees.write_tree(images.png_files(rows), folder)
    done = trees.in_tree(spark, folder)
    again = images.decoded(spark, folder).select(F.regexp_extract("path", r"([^/]*)\.png$", 1).alias("target"), F.md5("data").alias("after"))
    both = rows.select("target", F.md5("data").alias("before")).join(again, "target", "left").join(done.select("target", "md5"), "target", "left")
    same = F.coalesce(F.col("before") == F.col("after"), F.lit(False))
    return both.agg(F.count("md5").alias("files"), F.bool_and(same).alias("same"), F.count_if(F.col("md5").isNull()).alias("left_over"), F.count("after").alias("read_back"))


@query(f"""WITH {FILES} SELECT doc_id || '.jpg' AS name, 'JPEG' AS format, width, height, CASE WHEN label = 1 THEN '4:2:0' ELSE '4:4:4' END AS subsampling,
180 + bytes AS size, 1024 >= 180 AS header_only FROM files""")
def header_scan(spark, sf_dir):
    """Documents as JPEG files of their length, found by a scan that reads headers only."""
    from .catalog_models import _jpeg_files

    rows = _jpeg_files(spark, sf_dir).withColumn("doc", F.regexp_extract("path", r"(?:^|_)(\d+)(?:_|\.)", 1))
    data = F.concat("content", F.call_function("repeat", F.lit("x"), F.col("size").cast("int") + 180 - F.octet_length("content")).cast("binary"))
    folder = b.scratch(spark, "jpegs")
    trees.write_tree(rows.select(F.concat("doc", F.lit(".jpg")).alias("name"), data.alias("content")), folder)
    found = trees.headers(spark, folder, extensions=("jpg",))
    probed = images.probes(found.withColumn("got", F.octet_length("content")))
    return probed.select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"), "format", "width", "height", "subsampling", "size", (F.col("got") <= 1024).alias("header_only"))
