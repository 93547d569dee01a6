"""Whole runs: training with calibration and threshold, final test, and comparison of models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, models, names, sketch, splits, stats
from ..steps import written


@dataclass
class Trained:
    model: object
    calibration: models.Calibrated
    threshold: float
    report: dict
    reference: DataFrame
    parts: DataFrame


def train(features: DataFrame, pipeline, group: str = "group_key", threshold_on: str = "cal", seed: int = 42) -> Trained:
    """Split by groups, fit, choose a calibration on the held-out slice, pick the threshold, report on the test part.

    features: label, f, group. threshold_on: the part that the threshold is chosen on; `test` is what the
    reference does, `cal` keeps the test part untouched.
    """
    rows = models.with_vector(splits.split_3way(features, group, seed=seed)).cache()
    model = pipeline.fit(rows.where("part = 'train'"))
    scored = models.scored(model, rows.where("part <> 'train'").select("label", "features", "part", group)).withColumn("y", F.col("label"))
    cal, test = scored.where("part = 'cal'").cache(), scored.where("part = 'test'").cache()
    kind, trials = models.choose_calibration(cal, group, seed=seed)
    calibration = models.Calibrated(kind, cal)
    tuned = calibration.apply(cal if threshold_on == "cal" else test)
    found = metrics.youden(tuned).first()
    threshold = float(found["threshold"]) if found and found["threshold"] is not None else 0.5
    final = calibration.apply(test)
    report = {"calibration": kind, "threshold": threshold, "threshold_on": threshold_on}
    report |= metrics.rates(metrics.confusion(final, threshold)).first().asDict()
    report |= {"auc": metrics.roc_auc(final).first()["auc"], "auc_uncalibrated": metrics.roc_auc(test).first()["auc"], "brier": metrics.brier(final).first()["brier"], "ece": metrics.calibration_error(final, 15).first()["ece"], "ece_uncalibrated": metrics.calibration_error(test, 15).first()["ece"]}
    long = features.select("label", F.posexplode("f").alias("col0", "x"))
    parts = rows.select(group, "part").distinct()
    for kept in (rows, cal, test):
        kept.unpersist()
    return Trained(model, calibration, threshold, report, stats.effect_sizes(long, "col0"), parts)


def final_test(scored: DataFrame, threshold: float, train_keys: DataFrame, key: str = "group_key") -> dict[str, DataFrame]:
    """Counts with intervals, AUC, calibration, sweep, histogram, and whether test groups occur in training.

    Scores are read once, into a count of each distinct one; the AUC and the sketch that all else follows from come from that.
    """
    counts = metrics.tallies(scored)
    classes = F.explode(F.array(F.struct(F.lit(0).alias("y"), F.col("neg").alias("n")), F.struct(F.lit(1).alias("y"), F.col("pos").alias("n")))).alias("c")
    rows = counts.select("p", classes).select("p", "c.y", "c.n").where("n > 0")
    wanted = sorted({*sketch.SWEEP, threshold})
    cells = written(sketch.sketch(rows, sketch.edges(wanted), n="n"), "sketch")
    return {
        "rates": sketch.sweep(cells, [threshold], undefined=None).drop("threshold"),
        "auc": metrics.auc_of(counts),
        "ece": sketch.calibration_error(cells, 10),
        "reliability": sketch.reliability(cells, 10),
        "brier": sketch.brier(cells),
        "histogram": sketch.histogram(cells),
        "sweep": sketch.sweep(cells, wanted),
        "sketch": cells,
        "contamination": names.contamination(train_keys, scored, key),
    }


def compared(features: DataFrame, pipelines: dict, group: str = "group_key", seed: int = 42) -> DataFrame:
    """(model, n, counts and rates, auc) of several models on one grouped split; metrics.best_model() picks one."""
    rows = models.with_vector(splits.split_3way(features, group, seed=seed)).cache()
    out = []
    for name, pipeline in pipelines.items():
        model = pipeline.fit(rows.where("part <> 'test'"))
        test = models.scored(model, rows.where("part = 'test'").select(F.col("label").alias("y"), "features"))
        one = metrics.rates(metrics.confusion(test)).join(F.broadcast(metrics.roc_auc(test).select("auc")))  # one row each
        out.append((name, *one.first()))
        kind = one.schema.simpleString()[7:-1].replace(":", " ")
    rows.unpersist()
    return features.sparkSession.createDataFrame(out, f"model string, {kind}")  # a row a model


def leave_one_generator_out(features: DataFrame, pipeline, generator: str = "generator", group: str = "group_key", held_share: float = 0.5, calibration: float = 0.10, seed: int = 42) -> DataFrame:
    """(held_out, n_train, n_cal, n_eval, threshold, roc_auc, acc_default, rec_default, acc_tuned, rec_tuned, f1_tuned) for each generator of class 1.

    The model never sees the held-out generator nor the held half of class 0. A slice of these, whole groups again, only places the
    threshold; the rest is scored at 0.5 and at that threshold. No rows with fewer than two generators.
    """
    made, real = features.where("label = 1"), features.where("label = 0")
    tags = sorted(r[0] for r in names.plausible_generators(made, generator).where(F.col(generator).isNotNull()).collect())  # 12 at most
    schema = "held_out string, n_train long, n_cal long, n_eval long, threshold double, roc_auc double, acc_default double, rec_default double, acc_tuned double, rec_tuned double, f1_tuned double"
    out = []
    real = splits.fractional_cut(real, group, held_share, seed, "held_").cache()
    for tag in tags if len(tags) > 1 else []:
        learn, held = splits.leave_one_out(made, generator, tag)
        learn = real.where("not held_").drop("held_").unionByName(learn)
        cut = lambda rows: splits.fractional_cut(rows, group, calibration, seed + 1, "cal_")
        rest = cut(real.where("held_").drop("held_")).unionByName(cut(held))
        learn = models.with_vector(learn).cache()
        model = pipeline.fit(learn)
        got = models.scored(model, models.with_vector(rest)).select(F.col("label").alias("y"), "p", "cal_").cache()
        cal, ev = got.where("cal_"), got.where("not cal_")
        best = metrics.youden(cal).first()
        threshold = float(best["threshold"]) if best and best["threshold"] is not None else 0.5  # a slice of one class
        plain, tuned = (metrics.rates(metrics.confusion(ev, t)).first() for t in (0.5, threshold))
        out.append((tag, learn.count(), cal.count(), plain["n"], threshold, metrics.roc_auc(ev).first()["auc"], plain["accuracy"], plain["recall"], tuned["accuracy"], tuned["recall"], tuned["f1"]))
        learn.unpersist()
        got.unpersist()
    real.unpersist()
    return features.sparkSession.createDataFrame(out, schema)  # a row a generator


def mean_gain(held_out: DataFrame) -> DataFrame:
    """(generators, gain): the mean accuracy that moving the threshold alone recovers."""
    return held_out.agg(F.count("*").alias("generators"), F.avg(F.col("acc_tuned") - F.col("acc_default")).alias("gain"))
