"""Splits and samples by keyed hashes: a row's part depends on its key and the seed, not on partitions or order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import written
from .ordered import running_sums


def draw(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) from md5 of the key and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def fold_of(key: Column, k: int, seed: int = 42) -> Column:
    """A fold 0..k-1 for a group key: all rows of a group share it."""
    return F.floor(draw(key, seed) * k).cast("int")


def group_shapes(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, n0, n1) as a written table: a group's rows of either class; its shape is the pair of numbers."""
    ones = F.count_if(F.col(label) == 1)
    return written(rows.groupBy(group).agg((F.count("*") - ones).alias("n0"), ones.alias("n1")), "groups")


def dealt(groups: DataFrame, group: str, k: int, seed: int = 42) -> DataFrame:
    """group_shapes() with fold: all groups in one order are dealt to the folds forth and back.

    The order goes by n1 from large to small, by n0 upwards and downwards in turn, so that neighbours are alike in both, then by a seeded
    draw. So the folds' numbers of class 1 are within the largest group's of each other. A group's place is the number of groups of
    earlier shapes, a sum over the small table of shapes, plus its place within its shape, in order of the draw.
    """
    turn = F.when(F.col("n1") % 2 == 0, F.col("n0")).otherwise(-F.col("n0"))
    shapes = written(groups.groupBy("n0", "n1").agg(F.count("*").alias("m_")).withColumn("turn_", turn), "shapes")
    before = running_sums(shapes, "n1", {"upto_": "m_"}, descending=True, ties=("turn_",)).select("n0", "n1", (F.col("upto_") - F.col("m_")).alias("before_"))
    before = written(before, "offsets")
    inside = running_sums(groups.withColumn("draw_", draw(F.col(group), seed)), "draw_", {"inside_": F.lit(1)}, within=("n0", "n1"), ties=(group,))
    r = F.pmod(F.col("before_") + F.col("inside_") - 1, F.lit(2 * k))
    fold = F.when(r < k, r).otherwise(2 * k - 1 - r).cast("int")
    return inside.join(before, ["n0", "n1"]).select(group, "n0", "n1", fold.alias("fold"))


def with_parts(rows: DataFrame, groups: DataFrame, group: str, *columns: str) -> DataFrame:
    """rows with what their group has been given; a null group is a group too."""
    given = groups.select(F.col(group).alias("of_"), *columns)
    return rows.join(given, F.col(group).eqNullSafe(F.col("of_"))).drop("of_")


def balanced_folds(rows: DataFrame, group: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """rows with fold: whole groups, dealt so that folds are near in size and class shares; no group is in two."""
    return with_parts(rows, dealt(group_shapes(rows, group, label), group, k, seed), group, "fold")


def kfold_count(fraction: float) -> int:
    """Folds that stand for a test fraction: max(2, round(1 / fraction)), half to even."""
    return max(2, round(1 / fraction))


def split_3way(rows: DataFrame, group: str, label: str = "label", test: float = 0.2, calibration: float = 0.15, seed: int = 42) -> DataFrame:
    """rows with part: test, cal or train, whole groups at a time and near in class shares.

    test is the first of kfold_count(test) balanced folds, cal the first of those of the rest. Groups are counted once.
    """
    share = min(0.5, max(1e-6, calibration / (1 - test)))
    first = written(dealt(group_shapes(rows, group, label), group, kfold_count(test), seed), "folds")
    rest = dealt(first.where("fold <> 0").drop("fold"), group, kfold_count(share), seed + 1)
    parts = first.where("fold = 0").select(group, F.lit("test").alias("part"))
    parts = parts.unionByName(rest.select(group, F.when(F.col("fold") == 0, "cal").otherwise("train").alias("part")))
    return with_parts(rows, parts, group, "part")


def split_rows(rows: DataFrame, key: str, label: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with part: of each class the round(n x test) rows with the smallest draws are test, the others train. For tables without groups."""
    ranked = running_sums(rows.withColumn("draw_", draw(F.col(key), seed)), "draw_", {"rank_": F.lit(1)}, within=(label,), ties=(key,))
    sizes = rows.groupBy(F.col(label).alias("of_")).agg(F.round(F.count("*") * F.lit(test)).alias("take_"))
    out = ranked.join(sizes, F.col(label).eqNullSafe(F.col("of_")))
    return out.withColumn("part", F.when(F.col("rank_") <= F.col("take_"), "test").otherwise("train")).drop("draw_", "rank_", "of_", "take_")


def fractional_cut(rows: DataFrame, group: str, fraction: float, seed: int = 42, name: str = "cut") -> DataFrame:
    """rows with a mark on max(1, round(groups x fraction)) of the groups, those with the smallest draws; a row's own key makes it a cut by rows."""
    groups = rows.select(group).distinct().withColumn("draw_", draw(F.col(group), seed))
    n = cut_size(groups.count(), fraction)
    ranked = running_sums(groups, "draw_", {"rank_": F.lit(1)}, ties=(group,))
    chosen = ranked.select(F.col(group).alias("of_"), (F.col("rank_") <= n).alias(name))
    return rows.join(chosen, F.col(group).eqNullSafe(F.col("of_"))).drop("of_")


#: Chosen tags that are handed to every task, and the most that one task holds where they are dealt out.
SMALL, HELD = 100_000, 500_000


def marked(rows: DataFrame, tag: str, chosen: Sequence | DataFrame, name: str, small: int = SMALL, held: int = HELD) -> DataFrame:
    """rows with a mark on those whose tag is one of the chosen: a list, or a table whose first column holds the tags. A null tag isn't.

    A table is counted first. Up to `small` tags are broadcast; more are dealt by hash to so many tasks that each looks its rows up in some
    `held` tags. Rows are neither sorted nor held, so a frequent tag costs its task time but no memory.
    """
    if not isinstance(chosen, DataFrame):
        return rows.withColumn(name, F.coalesce(F.col(tag).isin(*chosen), F.lit(False)) if len(chosen) else F.lit(False))
    keys = chosen.select(F.col(chosen.columns[0]).alias("chosen_"))
    n = keys.count()
    if n <= small:
        keys = F.broadcast(keys.distinct())
    else:
        tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // held))
        rows, keys = rows.repartition(tasks, tag), keys.repartition(tasks, "chosen_").distinct().hint("shuffle_hash")
    return rows.join(keys, F.col(tag) == F.col("chosen_"), "left").withColumn(name, F.col("chosen_").isNotNull()).drop("chosen_")


def among(rows: DataFrame, tag: str, chosen: Sequence | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that marked() marks, the others)."""
    both = marked(rows, tag, chosen, "among_")
    return both.where("among_").drop("among_"), both.where("NOT among_").drop("among_")


def exact_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest draws, ties by key: a top-k, without a global sort."""
    return rows.withColumn("draw_", draw(F.col(key), seed)).orderBy("draw_", key).limit(n).drop("draw_")


def thinned(rows: DataFrame, is_extra: Column, key: str, fraction: float, seed: int = 42, within: Sequence[str] = ()) -> DataFrame:
    """All rows but those of is_extra, and of these about the fraction with the smallest draws, exactly round(n x fraction) of them.

    Ranks come from buckets of the draw, so no task holds all rows.
    """
    extra = rows.where(is_extra).withColumn("draw_", draw(F.col(key), seed))
    ranked = running_sums(extra, "draw_", {"rank_": F.lit(1)}, within=within, ties=(key,))
    totals = extra.groupBy(*within).agg(F.round(F.count("*") * F.lit(fraction)).alias("keep_"))
    ranked = ranked.join(totals, list(within)) if within else ranked.join(F.broadcast(totals))  # one row
    return rows.where(~is_extra).unionByName(ranked.where(F.col("rank_") <= F.col("keep_")).select(*rows.columns))


def leave_one_out(rows: DataFrame, tag: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows to learn from, held-out rows of one tag)."""
    held, learn = among(rows, tag, [value])
    return learn, held


def describe(rows: DataFrame, part: str = "part", label: str = "label") -> DataFrame:
    return rows.groupBy(part, label).agg(F.count("*").alias("n"))


def leaks(rows: DataFrame, group: str, part: str = "part") -> DataFrame:
    """(groups, leaking): groups that are in more than one part."""
    return rows.groupBy(group).agg(F.count_distinct(part).alias("n")).agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("leaking"))


def uniform_int(key: Column, low: int, high: int, seed: int = 42) -> Column:
    """round(low + u (high - low)), half away from zero."""
    return F.round(low + draw(key, seed) * (high - low)).cast("int")


def cut_size(n: int, fraction: float) -> int:
    """max(1, n x fraction rounded half to even)."""
    return max(1, round(n * fraction))

