"""Scores against truth: rank metrics, calibration, intervals, sweeps. y is 0 or 1, p a score in [0, 1]."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import written
from .ordered import running_sums, with_medians


def tallies(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(p, pos, neg): one row for each distinct score. All rank metrics start from this."""
    return written(scored.groupBy(F.col(p).alias("p")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")), "tallies")


def average_ranks(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """scored with rank_: ties share the mean of their places."""
    t = tallies(scored, p, y).withColumn("n", F.col("pos") + F.col("neg"))
    t = running_sums(t, "p", {"upto": "n"})
    return scored.join(t.select(F.col("p").alias(p), (F.col("upto") - (F.col("n") - 1) / 2e0).alias("rank_")), p)


def roc_auc(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(n1, n0, auc) by the rank identity; null with one class only."""
    return auc_of(tallies(scored, p, y))


def auc_of(counts: DataFrame) -> DataFrame:
    """roc_auc() of tallies()."""
    t = running_sums(counts.withColumn("n", F.col("pos") + F.col("neg")), "p", {"upto": "n"})
    rank = F.col("upto") - (F.col("n") - 1) / 2e0
    sums = t.agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"), F.sum(rank * F.col("pos")).alias("r1"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    return sums.select(n1.alias("n1"), n0.alias("n0"), F.try_divide(F.col("r1") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def roc_curve(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(p, tp, fp, tpr, fpr): one point for each distinct score as threshold `score >= p`."""
    t = tallies(scored, p, y)
    totals = t.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    t = running_sums(t, "p", {"tp": "pos", "fp": "neg"}, descending=True).join(F.broadcast(totals))  # one row
    return t.select("p", "tp", "fp", F.try_divide("tp", "all_pos").alias("tpr"), F.try_divide("fp", "all_neg").alias("fpr"))


def youden(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(threshold, j): the largest tpr - fpr; of equal ones the higher score."""
    j = F.round(F.col("tpr") - F.col("fpr"), 12)
    best = roc_curve(scored, p, y).where(j.isNotNull()).agg(F.max(F.struct(j.alias("j"), "p")).alias("best"))
    return best.select(F.col("best.p").alias("threshold"), F.col("best.j").alias("j"))


def confusion(scored: DataFrame, threshold: float | Column = 0.5, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """(by, n, tp, tn, fp, fn) in one pass."""
    hit, true = F.col(p) >= threshold, F.col(y) == 1
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit & true).alias("tp"), F.count_if(~hit & ~true).alias("tn"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))


def rates(counts: DataFrame, undefined: float | None = 0.0) -> DataFrame:
    """counts with accuracy, precision, recall, specificity, f1; what is undefined becomes `undefined` (None: null)."""
    fill = lambda c: c if undefined is None else F.coalesce(c, F.lit(undefined))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns({"accuracy": fill(F.try_divide(tp + tn, tp + tn + fp + fn)), "precision": fill(F.try_divide(tp, tp + fp)), "recall": fill(F.try_divide(tp, tp + fn)), "specificity": fill(F.try_divide(tn, tn + fp)), "f1": fill(F.try_divide(2 * tp, 2 * tp + fp + fn))})


def brier(scored: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"))


def right_closed_bin(p: Column, bins: int) -> Column:
    """1..bins: the bin (lo, hi] of equal width on [0, 1] that holds p; the first also holds 0."""
    return sum(((p > F.lit(i / bins)).cast("int") for i in range(1, bins)), F.lit(1))


def reliability(scored: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """(bin, n, mean_p, mean_y); empty bins are left out."""
    return scored.groupBy(right_closed_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def calibration_error(scored: DataFrame, bins: int, p: str = "p", y: str = "y") -> DataFrame:
    """(bins, ece): the bins' gaps weighted by their share."""
    return reliability(scored, bins, p, y).agg(F.lit(bins).alias("bins"), F.try_divide(F.sum(F.col("n") * F.abs(F.col("mean_y") - F.col("mean_p"))), F.sum("n")).alias("ece"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the score interval for k of n; (0, 0) for n = 0."""
    n_ = F.nullif(n.cast("double"), F.lit(0.0))
    share = k / n_
    scale = 1 + z * z / n_
    centre = (share + z * z / (2 * n_)) / scale
    half = z / scale * F.sqrt(share * (1 - share) / n_ + z * z / (4 * n_ * n_))
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float], p: str = "p", y: str = "y") -> DataFrame:
    """rates at each threshold: every row is counted once for the thresholds it passes, in one aggregation."""
    each = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    counts = scored.groupBy(F.col(p).alias("p"), F.col(y).alias("y")).count()  # far fewer rows before the explode
    rows = counts.select("p", "y", "count", each)
    hit, true = F.col("p") >= F.col("threshold"), F.col("y") == 1
    of = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0))
    return rates(rows.groupBy("threshold").agg(F.sum("count").alias("n"), of(hit & true).alias("tp"), of(~hit & ~true).alias("tn"), of(hit & ~true).alias("fp"), of(~hit & true).alias("fn")))


def histogram(scored: DataFrame, bins: int = 40, p: str = "p", by: Sequence[str] = ("y",)) -> DataFrame:
    """(by, bin, n): bins of equal width on [0, 1], left-closed, the last closed."""
    return scored.groupBy(*by, F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def strength(p: Column, t: float) -> Column:
    """strong, moderate or weak: the distance from the threshold as a share of the room on that side."""
    margin = F.abs(p - t) / F.greatest(F.when(p >= t, F.lit(1 - t)).otherwise(F.lit(t)), F.lit(1e-9))
    return F.when(margin > 0.6, "strong").when(margin > 0.25, "moderate").otherwise("weak")


def verdict(p: Column, t: float) -> Column:
    return F.when(p >= t, "AI").otherwise("real")


def score_summary(scored: DataFrame, t: float = 0.5, p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """(by, n, flagged, share, mean, median, low, high)."""
    hit = F.count_if(F.col(p) >= t)
    out = scored.groupBy(*by).agg(F.count("*").alias("n"), hit.alias("flagged"), F.try_divide(hit, F.count("*")).alias("share"), F.avg(p).alias("mean"), F.min(p).alias("low"), F.max(p).alias("high"))
    return with_medians(out, scored, {"median": F.col(p)}, by)


def best_model(compared: DataFrame, by: str = "auc", name: str = "model") -> DataFrame:
    """The row of the model with the largest measure; of equal ones the first by name."""
    return compared.orderBy(F.round(by, 12).desc_nulls_last(), name).limit(1)
