"""Running sums, places and medians over a whole table without sending it to one task.

Medians are selected bit by bit, from counts. For running sums, whose input is best a written table as it is read several times:

Rows are dealt by value into ranges between approximate quantiles, about one for every `FULL` rows and 4096 at
most; the quantiles are all that the driver sees. Sums within a range come from a window over it, sums before it
from the ranges' totals. Separate runs (`within`) have quantiles of their own, so a narrow run is cut too.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import dropped, written


def count_at_or_below(x: Column, bounds: Sequence[float]) -> Column:
    """How many of the bounds are at or below x: plain comparisons, so that they are compiled."""
    return sum(((x >= F.lit(b)).cast("int") for b in bounds), F.lit(0))


#: Rows a range is meant to hold, and the most ranges.
FULL, MOST = 500_000, 4096
#: Up to so many bounds are compared one by one; more are cut twice.
FLAT = 64


def _place(x: Column, bounds: Sequence[float]) -> Column:
    """count_at_or_below() of many sorted bounds: first among every 64th, then in the stretch behind it."""
    if len(bounds) <= FLAT:
        return count_at_or_below(x, bounds)
    stretches = [list(bounds[i : i + FLAT]) for i in range(0, len(bounds), FLAT)]
    which = count_at_or_below(x, [s[0] for s in stretches[1:]])
    inside = F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in stretches)), which + 1)
    return which * FLAT + F.size(F.filter(inside, lambda b: b <= x))


def bucketed(df: DataFrame, value: str, buckets: int | None = None, within: Sequence[str] = (), name: str = "bucket_") -> DataFrame:
    """df with the number of quantile bounds at or below value; equal values share a bucket, nulls are in bucket 0.

    buckets: how many, by default from the number of rows. A table of few rows is one bucket.
    """
    x = F.col(value).cast("double")
    buckets = buckets or min(MOST, -(-df.count() // FULL))
    if buckets < 2:
        return df.withColumn(name, F.lit(0))
    cuts = F.percentile_approx(x, [i / buckets for i in range(1, buckets)], 10_000)
    known = df.where(F.col(value).isNotNull() & ~F.isnan(x))
    if within:
        at = F.coalesce(F.size(F.filter("bounds_", lambda b: b <= x)), F.lit(0))
        rows = df.join(known.groupBy(*within).agg(F.array_distinct(cuts).alias("bounds_")), list(within), "left")
        return rows.withColumn(name, F.when(F.col(value).isNull(), 0).otherwise(at)).drop("bounds_")
    bounds = known.agg(cuts).first()[0] or []
    return df.withColumn(name, F.when(F.col(value).isNull(), 0).otherwise(_place(x, sorted(set(bounds)))))


def running_sums(df: DataFrame, value: str, sums: dict[str, Column | str], descending: bool = False, within: Sequence[str] = (), ties: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """df with each named sum over the rows up to and including this one in order of value, then ties.

    Rows that agree on value and ties are taken together (a range frame). within: separate runs, whose
    columns aren't null. A value that repeats without end should be summed up first, as metrics.tallies does: its rows share a range.
    """
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    buckets = buckets or min(MOST, -(-df.count() // FULL))
    frame_of = lambda *keys: Window.partitionBy(*keys).orderBy(way(value), *ties).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    if buckets < 2:  # FULL rows at most
        return df.withColumns({n: F.sum(x).over(frame_of(*within)) for n, x in sums.items()})
    rows = bucketed(df, value, buckets, within)
    totals = rows.groupBy(*within, "bucket_").agg(*(F.sum(x).alias(f"{n}_total") for n, x in sums.items()))
    before = Window.partitionBy(*within).orderBy(way("bucket_")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*within, "bucket_", *(F.coalesce(F.sum(f"{n}_total").over(before), F.lit(0)).alias(f"{n}_before") for n in sums))
    joined = rows.join(offsets, [*within, "bucket_"])
    out = joined.withColumns({n: F.col(f"{n}_before") + F.sum(x).over(frame_of(*within, "bucket_")) for n, x in sums.items()})
    return out.drop("bucket_", *(f"{n}_before" for n in sums))


def numbered(df: DataFrame, value: str, name: str = "row_number", within: Sequence[str] = ()) -> DataFrame:
    """df with 1, 2, ... in order of value, which should be unique."""
    return running_sums(df, value, {name: F.lit(1)}, within=within)


def running_max(df: DataFrame, value: str, of: str, name: str = "before") -> DataFrame:
    """df, whose values are unique, with the largest `of` among the rows before this one in order of value; null for the first."""
    rows = bucketed(df, value)
    tops = rows.groupBy("bucket_").agg(F.max(of).alias("top_"))
    earlier = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("bucket_", F.max("top_").over(earlier).alias("earlier_"))  # MOST rows at most
    here = F.max(of).over(Window.partitionBy("bucket_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(F.broadcast(tops), "bucket_").withColumn(name, F.greatest("earlier_", here)).drop("bucket_", "earlier_")


#: Bits of a key that a step of the selection counts by, and rows of a group up to which the rest of the key is counted at once.
STEP, DIRECT = 16, 500_000
TOP = (1 << 63) - 1


def _double_bits(method: str, x: Column) -> Column:
    return F.reflect(F.lit("java.lang.Double"), F.lit(method), x)


def keyed(df: DataFrame, value: str, by: Sequence[str], key: str = "key_") -> DataFrame:
    """(by, key): of each value that isn't null a long that sorts as the value does as a double (NaN last, -0 as 0)."""
    rows = df.where(F.col(value).isNotNull()).select(*by, _double_bits("doubleToLongBits", F.col(value).cast("double") + F.lit(0.0)).cast("long").alias(key))
    bits = F.col(key)
    return rows.withColumn(key, F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(TOP))))


def medians(df: DataFrame, value: str, by: Sequence[str], name: str = "median", direct: int = DIRECT) -> DataFrame:
    """(by, name): exact medians by selection on the bits of order-keeping keys. Null values don't count; a null group is a group.

    The first scan counts each group's rows by the upper 16 bits, which tells the two bins that hold its middle ranks. The second reads
    only rows of these bins and counts them by the rest of the key; if a group has more than `direct` rows there, by the
    next 16 bits, and so on. A group's counts are 65,536 rows or `direct` at most, and nothing is shuffled but counts.
    """
    own, keys = [f"by{i}_" for i in range(len(by))], keyed(df, value, by)
    keys = keys.select(*(F.col(c).alias(k) for c, k in zip(by, own, strict=True)), "key_")
    total, steps, done = F.col("total_"), [], 0
    ranks = [F.floor((total + 1) / 2), F.floor(total / 2) + 1]
    hit = [(F.col("before_") < r) & (r <= F.col("before_") + F.col("n_")) for r in ranks]
    picked = None
    while True:
        bits = 64 if picked is not None and most <= direct else done + STEP
        prefix = F.shiftright("key_", 64 - bits).alias("prefix_") if bits < 64 else F.col("key_").alias("prefix_")
        if picked is None:
            counts = keys.groupBy(*own, prefix).agg(F.count("*").alias("n_"))
            whole = Window.partitionBy(*own)
            counts = counts.withColumns({"total_": F.sum("n_").over(whole), "before_": F.sum("n_").over(whole.orderBy("prefix_")) - F.col("n_")})
        else:
            bins = picked.select(*(F.col(k).alias(f"of_{k}") for k in own), F.col("prefix_").alias("parent_"), F.col("before_").alias("below_"), "total_")
            same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in own] + [F.shiftright("key_", 64 - done) == F.col("parent_")]
            rows = keys.join(bins, functools.reduce(Column.__and__, same)).select(*own, "parent_", prefix, "below_", "total_")
            counts = rows.groupBy(*own, "parent_", "prefix_").agg(F.count("*").alias("n_"), F.first("below_").alias("below_"), F.first("total_").alias("total_"))
            inside = F.sum("n_").over(Window.partitionBy(*own, "parent_").orderBy("prefix_"))
            counts = counts.withColumn("before_", F.col("below_") + inside - F.col("n_"))
        counts = counts.where(hit[0] | hit[1]).select(*own, "prefix_", "n_", "total_", "before_")
        if bits == 64:
            break
        picked, done = written(counts, "bins"), bits  # two rows a group at most
        steps.append(picked)
        most = picked.groupBy(*own).agg(F.sum("n_").alias("n")).agg(F.max("n")).first()[0] or 0
    back = F.when(F.col("prefix_") >= 0, F.col("prefix_")).otherwise(F.col("prefix_").bitwiseXOR(F.lit(TOP)))
    counts = counts.select(*own, "total_", "before_", "n_", _double_bits("longBitsToDouble", back).cast("double").alias("value_"))
    middle = [F.max(F.when(h, F.col("value_"))) for h in hit]
    out = written(counts.groupBy(*own).agg(((middle[0] + middle[1]) / 2).alias(name)), "medians")  # a row a group
    dropped(*steps)
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, own, strict=True)), name)


def with_medians(summary: DataFrame, rows: DataFrame, columns: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """summary, one row for each value of `by`, with the exact median of each named column of rows."""
    keys = [f"by{i}_" for i in range(len(by))]
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name_"), c.cast("double").alias("value_")) for n, c in columns.items()))).alias("m")
    long = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), pairs).select(*keys, "m.name_", "m.value_")
    found = medians(long, "value_", [*keys, "name_"])
    wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("name_") == n, F.col("median"))).alias(n) for n in columns))
    if not by:
        return summary.join(F.broadcast(wide), how="left")  # one row
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)]
    return summary.join(wide, functools.reduce(Column.__and__, same), "left").drop(*keys)


def dense_places(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(value_, name): the distinct values with their place, from 0, in order, nulls last. Of any type that can be ordered.

    Ranges are cut between up to 255 of the values, those whose hashes are smallest: a sample that doesn't depend on partitions.
    """
    values = rows.select(F.col(column).alias("value_")).distinct()
    bounds = sorted(r[0] for r in values.where("value_ is not null").orderBy(F.xxhash64("value_"), "value_").limit(255).collect())
    kind = values.schema["value_"].dataType
    cut = F.array(*(F.lit(b).cast(kind) for b in bounds)) if bounds else F.array().cast(f"array<{kind.simpleString()}>")
    values = values.withColumn("bucket_", F.when(F.col("value_").isNull(), len(bounds) + 1).otherwise(F.size(F.filter(cut, lambda b: b <= F.col("value_")))))
    totals = values.groupBy("bucket_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))  # up to 257 rows
    here = F.row_number().over(Window.partitionBy("bucket_").orderBy("value_"))
    return values.withColumn("here_", here).join(F.broadcast(offsets), "bucket_").select("value_", (F.col("before_") + F.col("here_") - 1).alias(name))
