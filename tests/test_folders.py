"""Folder jobs on small image files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models
from tessera.plans import folders
from tessera.schema import WIDTH, feature_dict
from tessera.sources import images
from tests.test_pixels import png


@pytest.fixture(scope="module")
def pixels(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(4)
    for i in range(4):
        smooth = np.kron(rng.integers(0, 256, (24, 24, 3)), np.ones((20, 20, 1))).astype(int)
        (at / f"x_gen{i}_1.png").write_bytes(png(np.clip(smooth + rng.integers(0, 1 + 20 * (i % 2), smooth.shape), 0, 255)))
    (at / "X_gen0_1.PNG").write_bytes(png(rng.integers(0, 256, (460, 460, 3))))
    (at / "y_gen_1_qlo.png").write_bytes(png(rng.integers(0, 256, (460, 460, 3))))
    (at / "small.png").write_bytes(png(rng.integers(0, 256, (100, 460, 3))))
    (at / "bad.png").write_bytes(b"x")
    folders.require(spark, str(at))
    rows = images.decoded(spark, str(at), 1).cache()
    return rows


def test_missing_folder(spark):
    with pytest.raises(ValueError):
        folders.require(spark, "/nowhere/at/all")


def test_normalising_a_folder(spark, pixels):
    done = spark.createDataFrame([("x_gen1_1",)], "target string")
    made, counters, dropped = folders.normalise_folder(pixels, done)
    total = counters.where("label is null").first()
    assert (total.written, total.existed, total.skipped_small, total.skipped_augmented, total.failed) == (4, 1, 1, 1, 1)
    rows = made.select("target", "height", "width").collect()
    assert len(rows) == 4 and all((r.height, r.width) == (320, 320) for r in rows)
    assert len({r.target.lower() for r in rows}) == 4
    assert dropped.first().min_short == 100


def test_augmenting_a_folder(spark, pixels):
    big = pixels.where("path like '%x_gen%'")
    done = spark.createDataFrame([("x_gen1_1_soft",)], "target string")
    rows = folders.augment_folder(big, done=done).select("target", "variant", "quality").collect()
    assert len(rows) == 4 * 4 - 1 and all((40 <= r.quality <= 70) if r.variant == "qlo" else (70 <= r.quality <= 95) for r in rows)


def test_extract_score_explain(spark, pixels):
    big = pixels.where("path like '%x_gen%'")
    features = folders.extract_folder(big).select("path", "f", "status").cache()
    assert {r.status for r in features.collect()} == {"DONE"}
    noisy = F.col("path").rlike("gen[13]_").cast("int")
    train = models.with_vector(features.withColumn("label", noisy)).crossJoin(spark.range(10)).drop("id")
    model = models.boosted(3, 2).fit(train)
    rows, summary = folders.score_folder(model, features, 0.5, truth=1)
    assert summary.first()["accuracy"] == 0.5 and rows.count() == 4
    told = folders.explain(model, features, feature_dict(spark), 0.5, 3).collect()
    assert len(told) == 12 and {r.rank for r in told} == {1, 2, 3}
    by_block = folders.importance_by_block(models.importances(model, WIDTH, spark), feature_dict(spark)).collect()
    assert abs(sum(r.importance for r in by_block) - 1) < 1e-9


def test_steps_and_sql(spark, pixels):
    steps = folders.normalise_steps(pixels.where("error is null")).groupBy("step").agg(F.count_if("ok").alias("n")).collect()
    assert {r.step: r.n for r in steps} == {"decode": 7, "crop": 6, "resize": 6, "chroma": 6, "compress": 6}
    folders.register(spark)
    pixels.where("path like '%x_gen0%'").createOrReplaceTempView("pix")
    r = spark.sql("SELECT size(extract_features(data, height, width, n_channels)) AS n, length(normalise_image(data, height, width, n_channels)) AS b FROM pix").first()
    assert (r.n, r.b) == (WIDTH, 320 * 320 * 3)
    shown = folders.display_arrays(np.zeros((300, 300, 3), np.uint8))
    assert shown["spectrum"].shape == (256, 256) and shown["diagonal"].shape == (131, 131)
