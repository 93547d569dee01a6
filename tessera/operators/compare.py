"""Two classes side by side: crosstabs, numeric summaries, single-column separators, folder comparability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import written
from .ordered import medians, running_sums, with_medians


def crosstab(rows: DataFrame, key: str, label: str = "label", top: int | None = None) -> DataFrame:
    """(value, n0, n1, pct0, pct1, exclusive): counts of each value in both classes and their share of the class.

    exclusive: the value occurs in one class only. top: the commonest values only, ties by value.
    """
    counts = rows.groupBy(F.col(key).cast("string").alias("value")).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    totals = counts.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    if top:
        counts = counts.orderBy(F.desc(F.col("n0") + F.col("n1")), "value").limit(top)
    out = counts.join(F.broadcast(totals))  # one row
    return out.select("value", "n0", "n1", (100 * F.try_divide("n0", "t0")).alias("pct0"), (100 * F.try_divide("n1", "t1")).alias("pct1"), ((F.col("n0") == 0) | (F.col("n1") == 0)).alias("exclusive"))


def exclusive_share(rows: DataFrame, key: str, label: str = "label", top: int | None = None) -> DataFrame:
    """(n, exclusive_n, share): rows whose value, one of the `top` commonest, occurs in one class only; the share is of all rows of both classes."""
    n = F.col("n0") + F.col("n1")
    listed = crosstab(rows, key, label, top).agg(F.sum(F.when(F.col("exclusive"), n).otherwise(0)).alias("exclusive_n"))
    every = rows.agg(F.count_if(F.col(label).isin(0, 1)).alias("n"))
    return every.join(F.broadcast(listed)).withColumn("share", F.try_divide("exclusive_n", "n"))  # one row each


def numeric_summary(long: DataFrame, name: str = "name", label: str = "label", x: str = "x") -> DataFrame:
    """(name, of each class median, mean, min, max; gap: larger over smaller median; overlap: whether the ranges meet)."""
    of = lambda k: F.when(F.col(label) == k, F.col(x))
    out = long.groupBy(name).agg(*(f(of(k)).alias(f"{n}_{k}") for k in (0, 1) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))
    mid = medians(long.where(F.col(label).isin(0, 1)), x, [name, label])
    out = out.join(mid.groupBy(name).agg(*(F.max(F.when(F.col(label) == k, F.col("median"))).alias(f"median_{k}") for k in (0, 1))), name, "left")
    out = out.withColumn("gap", F.try_divide(F.greatest("median_0", "median_1"), F.least("median_0", "median_1")))
    return out.withColumn("overlap", F.least("max_0", "max_1") >= F.greatest("min_0", "min_1"))


def best_cut(rows: DataFrame, x: str, label: str = "label") -> DataFrame:
    """(n, base, accuracy): the best accuracy of one threshold on x in either direction; cuts lie between distinct values only."""
    t = written(rows.groupBy(F.col(x).cast("double").alias("x")).agg(F.count_if(F.col(label) == 0).alias("c0"), F.count_if(F.col(label) == 1).alias("c1")), "tallies")
    totals = t.agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"), F.max("x").alias("last"))
    t = running_sums(t, "x", {"below0": "c0", "below1": "c1"}).join(F.broadcast(totals))  # one row
    n = F.col("n0") + F.col("n1")
    accuracy = F.when(F.col("x") < F.col("last"), F.try_divide(F.col("below0") + F.col("n1") - F.col("below1"), n))
    out = t.agg(F.max(n).alias("n"), F.max(F.try_divide(F.greatest("n0", "n1"), n)).alias("base"), F.max(accuracy).alias("hi"), F.min(accuracy).alias("lo"))
    return out.select("n", "base", F.greatest("base", "hi", 1 - F.col("lo")).alias("accuracy"))


def folder_stats(files: DataFrame, by: Sequence[str] = ("folder",), width: str = "width", height: str = "height", size: str = "bytes", kind: str = "format", floor: int = 256) -> DataFrame:
    """One row a folder: counts, medians and means of the sizes, the short side's range, files under the floor, median bytes a pixel and size, formats."""
    short = F.least(width, height)
    density = F.col(size) / F.nullif(F.col(width) * F.col(height), F.lit(0))
    out = files.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(width).alias("mean_width"), F.avg(height).alias("mean_height"), F.min(short).alias("min_short"), F.max(short).alias("max_short"),
        F.count_if(short < floor).alias("small"), F.count_if(F.lower(kind).isin("jpg", "jpeg")).alias("jpg"), F.count_if(F.lower(kind) == "png").alias("png"))
    columns = {"median_width": F.col(width), "median_height": F.col(height), "median_short": short, "median_bpp": density, "median_kb": F.col(size) / 1024}
    return with_medians(out, files, columns, by)


def folder_verdict(stats: DataFrame, folder: str = "folder", resolution: float = 1.25, density: float = 1.35, small: float = 0.05) -> DataFrame:
    """(resolution_gap, density_gap, small_share, format_mismatch and a flag for each): rules over the two folders' stats.

    Gaps are those of the median short side and of the median bytes a pixel; null where a median isn't above 0.
    """
    ratio = lambda c: F.when(F.min(c) > 0, F.try_divide(F.max(c), F.min(c)))
    jpg, png = F.col("jpg") > 0, F.col("png") > 0
    out = stats.agg(ratio(F.col("median_short")).alias("resolution_gap"), ratio(F.col("median_bpp")).alias("density_gap"), F.max(F.col("small") / F.greatest("n", F.lit(1))).alias("small_share"), ((F.count_distinct(jpg) > 1) | (F.count_distinct(png) > 1)).alias("format_mismatch"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumns({"resolution_bad": flag(F.col("resolution_gap") >= resolution), "density_bad": flag(F.col("density_gap") >= density), "small_bad": flag(F.col("small_share") > small)}).withColumn("problems", sum((F.col(c).cast("int") for c in ("resolution_bad", "density_bad", "small_bad", "format_mismatch")), F.lit(0)))


def class_percent(n: str, by: Sequence[str]) -> Column:
    """A count as percent of its group's total, over a table of one row for each value and group."""
    return 100 * F.col(n) / F.sum(n).over(Window.partitionBy(*by))


def class_balance(rows: DataFrame, label: str = "label") -> DataFrame:
    """(larger, smaller, ratio) of the classes' sizes."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(F.max("n").alias("larger"), F.min("n").alias("smaller"), F.try_divide(F.max("n"), F.min("n")).alias("ratio"))
