"""An evaluation sketch: counts between all bin edges and thresholds, from which every report over scores follows.

All bins and thresholds are cuts `p >= edge` on doubles: a right-closed bin (lo, hi] begins at the next double after lo. A cell lies
between two neighbouring edges, so a sketch has a row for each set, class and cell at most, whatever the number of scores.
Sketches over the same edges are merged by adding them up: those of days, folders or runs can be kept and put together later.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import rates, wilson
from .ordered import count_at_or_below

#: The bins of the reports.
RELIABILITY, HISTOGRAM = (10, 15), 40
#: The sweep's thresholds, besides the chosen one.
SWEEP = (0.3, 0.4, 0.5, 0.6, 0.7)


def right_closed(bins: int) -> list[float]:
    """Where the bins (i / bins, (i + 1) / bins] after the first begin."""
    return [math.nextafter(i / bins, math.inf) for i in range(1, bins)]


def left_closed(bins: int) -> list[float]:
    """Where the bins floor(p * bins) after the first begin: the least double that isn't under i once multiplied."""
    out = []
    for i in range(1, bins):
        t = i / bins
        while t * bins >= i:
            t = math.nextafter(t, -math.inf)
        while t * bins < i:
            t = math.nextafter(t, math.inf)
        out.append(t)
    return out


def edges(thresholds: Sequence[float] = SWEEP, reliability: Sequence[int] = RELIABILITY, histogram: int = HISTOGRAM) -> list[float]:
    return sorted({*thresholds, *left_closed(histogram), *(e for bins in reliability for e in right_closed(bins))})


def sketch(scored: DataFrame, cuts: Sequence[float], by: Sequence[str] = (), p: str = "p", y: str = "y", n: str | None = None) -> DataFrame:
    """(by, y, low, n, sum_p, sum_gap): rows with p from the edge `low` to the next one (-inf: under the first), sums of p and of (p - y) ** 2. n: a column of multiplicities.

    Null and NaN scores are left out.
    """
    n_ = F.col(n) if n else F.lit(1)
    rows = scored.where(F.col(p).isNotNull() & ~F.isnan(p))
    low = F.element_at(F.array(*map(F.lit, (-math.inf, *cuts))), count_at_or_below(F.col(p), cuts) + 1)
    gap = F.pow(F.col(p) - F.col(y), F.lit(2))
    return rows.groupBy(*by, F.col(y).cast("int").alias("y"), low.alias("low")).agg(F.sum(n_).alias("n"), F.sum(F.col(p) * n_).alias("sum_p"), F.sum(gap * n_).alias("sum_gap"))


def merged(sketches: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """One sketch of all."""
    rows = functools.reduce(DataFrame.unionByName, sketches)
    return rows.groupBy(*by, "y", "low").agg(*(F.sum(c).alias(c) for c in ("n", "sum_p", "sum_gap")))


def _bin(cuts: Sequence[float], first: int) -> Column:
    return (count_at_or_below(F.col("low"), cuts) + first).alias("bin")


def reliability(cells: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, n, mean_p, mean_y); empty bins are left out."""
    n = F.sum("n")
    return cells.groupBy(*by, _bin(right_closed(bins), 1)).agg(n.alias("n"), (F.sum("sum_p") / n).alias("mean_p"), (F.sum(F.col("n") * F.col("y")) / n).alias("mean_y"))


def calibration_error(cells: DataFrame, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, bins, ece)."""
    gap = F.sum(F.col("n") * F.abs(F.col("mean_y") - F.col("mean_p")))
    return reliability(cells, bins, by).groupBy(*by).agg(F.lit(bins).alias("bins"), F.try_divide(gap, F.sum("n")).alias("ece"))


def histogram(cells: DataFrame, bins: int = HISTOGRAM, by: Sequence[str] = ("y",)) -> DataFrame:
    """(by, bin, n): bins of equal width, left-closed."""
    return cells.groupBy(*by, _bin(left_closed(bins), 0)).agg(F.sum("n").alias("n"))


def sweep(cells: DataFrame, thresholds: Sequence[float], by: Sequence[str] = (), undefined: float | None = 0.0) -> DataFrame:
    """(by, threshold, counts, rates, and bounds of accuracy) at each threshold, which must be among the sketch's edges."""
    rows = cells.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))  # a cell for each threshold
    hit, true = F.col("low") >= F.col("threshold"), F.col("y") == 1
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    counts = rows.groupBy(*by, "threshold").agg(F.sum("n").alias("n"), of(hit & true).alias("tp"), of(~hit & ~true).alias("tn"), of(hit & ~true).alias("fp"), of(~hit & true).alias("fn"))
    low, high = wilson(F.col("tp") + F.col("tn"), F.col("n"))
    return rates(counts, undefined).withColumns({"accuracy_low": low, "accuracy_high": high})


def brier(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*by).agg(F.try_divide(F.sum("sum_gap"), F.sum("n")).alias("brier"))
