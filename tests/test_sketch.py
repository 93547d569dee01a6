"""The evaluation sketch against reports taken from the scores themselves."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics, sketch
from tessera.plans import training


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(2)
    edge = [i / k for k in (10, 15, 40) for i in range(k + 1)] + list(sketch.SWEEP)
    near = [math.nextafter(v, d) for v in edge for d in (0.0, 1.0)]
    values = edge + near + [rng.random() for _ in range(400)]
    rows = [(i, v, int(rng.random() < v), f"s{i % 3}") for i, v in enumerate(values)]
    return spark.createDataFrame([*rows, (-1, None, 1, "s0"), (-2, math.nan, 0, "s0")], "id int, p double, y int, s string").repartition(3)


def rows_of(df, places=10):
    return sorted((tuple(sorted((k, round(v, places) if isinstance(v, float) else v) for k, v in r.asDict().items())) for r in df.collect()), key=str)


def test_reports_are_those_of_the_scores(spark, scored):
    fine = scored.where("p is not null and not isnan(p)").cache()
    cells = sketch.sketch(scored, sketch.edges()).cache()
    for bins in (10, 15):
        assert rows_of(sketch.reliability(cells, bins)) == rows_of(metrics.reliability(fine, bins))
        assert rows_of(sketch.calibration_error(cells, bins)) == rows_of(metrics.calibration_error(fine, bins))
    assert rows_of(sketch.histogram(cells)) == rows_of(metrics.histogram(fine))
    assert rows_of(sketch.brier(cells)) == rows_of(metrics.brier(fine))
    assert rows_of(sketch.sweep(cells, list(sketch.SWEEP)).drop("accuracy_low", "accuracy_high")) == rows_of(metrics.threshold_sweep(fine, list(sketch.SWEEP)))
    assert cells.count() <= 2 * (len(sketch.edges()) + 1)


def test_sketches_merge(spark, scored):
    whole = sketch.sketch(scored, sketch.edges(), ["s"])
    parts = [sketch.sketch(scored.where(F.pmod("id", F.lit(4)) == k), sketch.edges(), ["s"]) for k in range(4)]
    assert rows_of(sketch.merged(parts, ["s"])) == rows_of(whole)
    assert sketch.sketch(scored.limit(0), sketch.edges()).count() == 0


def test_final_test_reads_scores_once(spark, scored, tmp_path):
    scored.where("p is not null and not isnan(p)").withColumn("group_key", F.col("id")).write.parquet(str(tmp_path / "scores"))
    rows = spark.read.parquet(str(tmp_path / "scores"))
    out = training.final_test(rows, 0.55, spark.createDataFrame([(1,)], "group_key int"))
    plans = {k: v._jdf.queryExecution().optimizedPlan().toString() for k, v in out.items()}
    assert all("group_key" in p for k, p in plans.items() if k == "contamination") and not any("s#" in p and "id#" in p for k, p in plans.items() if k != "contamination")
    want = metrics.rates(metrics.confusion(rows, 0.55), undefined=None).first()
    got = out["rates"].first()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in ("n", "tp", "tn", "fp", "fn", "accuracy", "f1")) and got.accuracy_low < got.accuracy < got.accuracy_high
    assert abs(out["auc"].first()["auc"] - metrics.roc_auc(rows).first()["auc"]) < 1e-12 and out["sweep"].count() == 6
