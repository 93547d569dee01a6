"""Pipelines see their rows in one partition a core, whatever plan made them."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import models


def partitions_seen(pipeline, rows):
    seen = []

    class Stage:
        def fit(self, df):
            seen.append([len(p) for p in df.rdd.glom().collect()])

    pipeline.pipeline = Stage()
    pipeline.fit(rows)
    return seen[0]


def test_forest_and_regression_take_even_partitions(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i % 2, rng.normal(size=3).tolist()) for i in range(400)], "label int, f array<double>")
    n = spark.sparkContext.defaultParallelism
    for some in (rows.coalesce(1), rows.repartition(200)):
        for pipeline in (models.forest(2, 2), models.logistic(400)):
            sizes = partitions_seen(pipeline, models.with_vector(some))
            assert len(sizes) == n and sum(sizes) == 400 and min(sizes) > 0


def test_a_forest_does_not_depend_on_the_plan(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, int(x.sum() > 0), x.tolist()) for i, x in enumerate(rng.normal(size=(300, 4)))], "i int, label int, f array<double>")
    made = [models.exported_trees(models.forest(5, 3).fit(models.with_vector(r))) for r in (rows.coalesce(1), rows.orderBy(F.desc("i")).repartition(7))]
    assert made[0] == made[1]
