"""Guarded statistics of groups: the seven base statistics, moments, entropy, correlation, effect size.

Conventions: standard deviation and variance of features divide by n - 1, those of effect sizes by n; skewness and
kurtosis are biased and kurtosis isn't an excess; whatever constant or empty data leave undefined is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def skewness(x: str) -> Column:
    return or_zero(F.skewness(x))


def kurtosis(x: str) -> Column:
    """Non-excess; 0 for constant data."""
    return or_zero(F.kurtosis(x) + 3)


def entropies(df: DataFrame, value: str, by: Sequence[str], bins: int = 256) -> DataFrame:
    """(by, entropy) in bits of each group's histogram over its own range; 0 for constant groups."""
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("x")).where("x is not null")
    ends = rows.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = rows.join(ends, by).withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))).otherwise(0))
    counts = rows.groupBy(*by, "bin").agg(F.count("*").cast("double").alias("n"))
    # -sum p log2 p = log2 N - (sum n log2 n) / N, so one more sum is enough
    return counts.groupBy(*by).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def base_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by, mean, std, variance, energy, entropy, skewness, kurtosis)."""
    x = F.col(value).cast("double")
    moments = df.groupBy(*by).agg(F.avg(x).alias("mean"), or_zero(F.stddev_samp(x)).alias("std"), or_zero(F.var_samp(x)).alias("variance"), F.avg(x * x).alias("energy"), or_zero(F.skewness(x)).alias("skewness"), or_zero(F.kurtosis(x) + 3).alias("kurtosis"))
    return moments.join(entropies(df, value, by), list(by), "left")


def pearson(a: str, b: str) -> Column:
    """Correlation of two columns; 0 if one is constant."""
    return or_zero(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def melted(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, name, x): the given columns as rows, in one pass."""
    return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns))).alias("m")).select(*keys, "m.name", "m.x")


def class_moments(long: DataFrame, name: str = "name", label: str = "label", x: str = "x") -> DataFrame:
    """(name, mean_0, mean_1, std_0, std_1, var_0, var_1): population moments of each column in both classes, one aggregation."""
    of = lambda k: F.when(F.col(label) == k, F.col(x))
    return long.groupBy(name).agg(*(f(of(k)).alias(f"{n}_{k}") for k in (0, 1) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("var", F.var_pop))))


def pooled() -> Column:
    return F.greatest(F.sqrt((F.col("var_0") + F.col("var_1")) / 2), F.lit(1e-12))


def effect_sizes(long: DataFrame, name: str = "name", label: str = "label", x: str = "x") -> DataFrame:
    """class_moments() with pooled and d, the distance of the means in pooled standard deviations."""
    return class_moments(long, name, label, x).withColumn("pooled", pooled()).withColumn("d", or_zero(F.abs(F.col("mean_1") - F.col("mean_0")) / F.col("pooled")))


def top(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def placed(report: DataFrame, by: str, tie: str, descending: bool = False, name: str = "place") -> DataFrame:
    """A report's rows with their place, from 1, in the order it is shown in. For tables of a few rows, such as a row a variant or block."""
    first = F.round(by, 12)
    return report.withColumn(name, F.row_number().over(Window.orderBy(first.desc() if descending else first.asc(), tie)))
