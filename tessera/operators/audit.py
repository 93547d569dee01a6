"""Container audit: what a classifier without pixels could learn, and verdict rules over it; shift between sets and variants."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..steps import dropped, written
from . import boosting, compare, metrics, names, splits, stats
from .ordered import with_medians


#: The columns of the metadata-only classifier.
CUE_NUMERIC = ("size", "bpp", "width", "height", "area", "aspect", "q_dc", "q_mean")
CUE_CATEGORICAL = ("qhash", "subsampling", "ext")


def trivial_cue(probes: DataFrame, numeric: Sequence[str] = CUE_NUMERIC, categorical: Sequence[str] = CUE_CATEGORICAL, group: str = "source", label: str = "label", k: int = 5, rounds: int = 100, seed: int = 42) -> DataFrame:
    """(fold, n, accuracy, auc) of a classifier on metadata only, balanced grouped folds. Near 0.5 is what one wants.

    Missing numbers are -1, missing categories a code of their own. A fold that can't be learnt (one class) is left out.
    """
    rows = probes
    for c in categorical:
        rows = names.ordinal(rows, c, f"{c}_code")
    rows = splits.balanced_folds(rows, group, label, k, seed)
    used = [*(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in numeric), *(F.col(f"{c}_code").cast("double").alias(c) for c in categorical)]
    rows = rows.select(F.col(label).alias("label"), "fold", *used)
    rows = written(rows.select("label", "fold", F.array(*numeric, *categorical).alias("f")), "cues")
    models = boosting.fit(rows, range(k), fold="fold", rules=boosting.Rules(rounds))  # all folds in the same jobs
    out = []
    for fold, model in sorted(models.items()):
        test = written(model.scored(rows.where(F.col("fold") == fold)).select(F.col("label").alias("y"), "p"), "scores")
        one = metrics.rates(metrics.confusion(test)).join(F.broadcast(metrics.roc_auc(test))).select(F.lit(fold).alias("fold"), "n", "accuracy", "auc")  # one row each
        out.append(tuple(one.first()))
        dropped(test)
    dropped(rows)
    return probes.sparkSession.createDataFrame(out, "fold int, n long, accuracy double, auc double")  # k rows


def fold_summary(folds: DataFrame) -> DataFrame:
    """(accuracy, accuracy_sd, auc, auc_sd, sd_from_chance) over folds, population deviations; 0 sd from chance where folds agree wholly."""
    out = folds.agg(F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("accuracy_sd"), F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("auc_sd"))
    return out.withColumn("sd_from_chance", F.when(F.col("auc_sd") > 0, (F.col("auc") - 0.5) / F.col("auc_sd")).otherwise(0.0))


def container_facts(probes: DataFrame, folds: DataFrame, width: str = "width", density: str = "bpp", extension: str = "ext", table: str = "qhash", label: str = "label") -> DataFrame:
    """One row of what verdict() judges: auc, sd_from_chance, extension_share, table_share, and of width and density the median gap and the best single cut's accuracy.

    A gap is 1 where a class has no rows or a median isn't above 0; a cut's accuracy is 0.5 where a class has no rows.
    """
    facts = fold_summary(folds).select("auc", "sd_from_chance")
    for name, column in (("extension_share", extension), ("table_share", table)):
        facts = facts.join(F.broadcast(compare.exclusive_share(probes, column, label, top=12).select(F.coalesce("share", F.lit(0.0)).alias(name))))  # one row each
    for name, column in (("resolution", width), ("density", density)):
        rows = probes.select(F.col(label).alias("label"), F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
        mid = compare.numeric_summary(rows.withColumn("name", F.lit(name))).select("median_0", "median_1", "gap")
        gap = mid.agg(F.coalesce(F.max(F.when(F.least("median_0", "median_1") > 0, F.col("gap"))), F.lit(1.0)).alias(f"{name}_gap"), F.count_if(F.col("median_0").isNotNull() & F.col("median_1").isNotNull()).alias("both_"))
        cut = compare.best_cut(rows, "x").select(F.col("accuracy").alias("cut_"))
        one = gap.join(F.broadcast(cut)).select(f"{name}_gap", F.when(F.col("both_") > 0, F.col("cut_")).otherwise(0.5).alias(f"{name}_cut"))  # one row each
        facts = facts.join(F.broadcast(one))
    return facts


def verdict(facts: DataFrame) -> DataFrame:
    """facts with a flag for each rule, their number, and a verdict: problems, residual (none, but three deviations above chance) or clean."""
    auc = F.col("auc")
    rules = {
        "cue_uninterpretable": auc >= 0.80,
        "cue_shortcut": (auc >= 0.65) & (auc < 0.80),
        "tables_exclusive": F.col("table_share") >= 0.5,
        "extensions_exclusive": F.col("extension_share") >= 0.5,
        "density": F.col("density_gap") >= 1.35,
        "resolution": F.col("resolution_gap") >= 1.25,
        "width_cut": (F.col("resolution_cut") >= 0.90) & (F.col("resolution_gap") < 1.25),
        "density_cut": (F.col("density_cut") >= 0.90) & (F.col("density_gap") < 1.25),
    }
    out = facts.withColumns({f"is_{k}": F.coalesce(v, F.lit(False)) for k, v in rules.items()})
    out = out.withColumn("problems", sum((F.col(f"is_{k}").cast("int") for k in rules), F.lit(0)))
    return out.withColumn("verdict", F.when(F.col("problems") > 0, "problems").when(F.col("sd_from_chance") >= 3, "residual").otherwise("clean"))


def container_audit(probes: DataFrame, k: int = 5, rounds: int = 100, every: bool = True) -> dict[str, DataFrame]:
    """The whole audit over probes(): is the label recoverable without pixels?

    unreadable: files that couldn't be read, left out of the rest; counts by class and augmentation; collisions of
    stems among the originals; crosstabs by property; numbers by class; folds of the classifier without pixels over
    the originals (cue) and, with `every`, over all files (cue_all); and the verdict over the originals.
    """
    probes = written(probes, "probes")  # files are read and parsed once
    fine = probes.where(F.col("error").isNull())
    native = fine.where(~F.col("augmented"))
    tables = lambda rows, kinds: functools.reduce(DataFrame.unionByName, (compare.crosstab(rows, c, top=12).withColumn("property", F.lit(c)) for c in kinds))
    cue = trivial_cue(native, k=k, rounds=rounds)
    found = {
        "unreadable": probes.where(F.col("error").isNotNull()).select("path", "error"),
        "counts": fine.groupBy("label", "augmented").agg(F.count("*").alias("n")),
        "collisions": names.collisions(native, "source", "ext"),
        "crosstabs": tables(native, ("ext", "format", "qhash", "subsampling")),
        "augmented_crosstab": tables(fine.where("augmented"), ("qhash",)),
        "numbers": compare.numeric_summary(stats.melted(native, ["label"], ["width", "bpp"])),
        "cue": cue,
        "verdict": verdict(container_facts(native, cue)),
    }
    if every and not fine.where("augmented").isEmpty():
        found["cue_all"] = trivial_cue(fine, k=k, rounds=rounds)
    return found


def flip_table(scores: DataFrame, variant: str = "variant", p: str = "p", t: float = 0.5, control: str = "control", gate: float = 0.10) -> DataFrame:
    """(variant, n, flip_rate, mean, median, excess over the control, control_ok)."""
    scores = scores.select(F.col(variant).alias("variant"), F.col(p).alias("p"))
    rates = scores.groupBy("variant").agg(F.count("*").alias("n"), F.avg((F.col("p") >= t).cast("double")).alias("flip_rate"), F.avg("p").alias("mean"))
    rates = with_medians(rates, scores, {"median": F.col("p")}, ["variant"])
    base = rates.where(F.col("variant") == control).agg(F.max("flip_rate").alias("base"))
    return rates.join(F.broadcast(base)).select("variant", "n", "flip_rate", "mean", "median", (F.col("flip_rate") - F.col("base")).alias("excess"), (F.col("base") <= gate).alias("control_ok"))  # one row


def worst_variant(flips: DataFrame, control: str = "control") -> DataFrame:
    """The row of flip_table() with the largest flip rate but the control's; of equal ones the first by name. None unless the control holds."""
    return flips.where((F.col("variant") != control) & F.col("control_ok")).orderBy(F.round("flip_rate", 12).desc(), "variant").limit(1)


def signed_shift(long: DataFrame, reference: DataFrame, by: Sequence[str] = ("set",)) -> DataFrame:
    """(by, col0, shift): each set's mean against the real class in pooled deviations, positive towards the AI class."""
    means = long.groupBy(*by, "col0").agg(F.avg("x").alias("m"))
    toward = F.signum(F.col("mean_1") - F.col("mean_0"))
    return means.join(reference, "col0").select(*by, "col0", ((F.col("m") - F.col("mean_0")) / F.col("pooled") * toward).alias("shift"))


def block_shift(shift: DataFrame, blocks: DataFrame, by: Sequence[str] = ("set",)) -> DataFrame:
    """(by, block, shift): the mean shift of each block's columns; blocks: (col0, block) of the layout."""
    return shift.join(F.broadcast(blocks.select("col0", "block")), "col0").groupBy(*by, "block").agg(F.avg("shift").alias("shift"))  # a row a column of the layout


def top_shift(shift: DataFrame, k: int = 6, by: Sequence[str] = ("set",)) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.round("shift", 9).desc(), "col0")
    return shift.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def in_domain_gate(scored: DataFrame, t: float = 0.5, least: float = 0.90) -> DataFrame:
    """(n, real_accuracy, ok): accuracy on real rows of the held-out part."""
    real = scored.where(F.col("y") == 0)
    return real.agg(F.count("*").alias("n"), F.avg((F.col("p") < t).cast("double")).alias("real_accuracy")).withColumn("ok", F.col("real_accuracy") >= least)


def markers(lines: DataFrame, wanted: Sequence[str], file: str = "path", value: str = "value") -> DataFrame:
    """(file, of each marker whether a line has it, any): whether code or a log is current."""
    out = lines.groupBy(file).agg(*(F.bool_or(F.contains(F.col(value), F.lit(m))).alias(f"has_{m}") for m in wanted))
    return out.withColumn("any", F.greatest(*(F.col(f"has_{m}").cast("int") for m in wanted), F.lit(0)) > 0)


def setup(facts: DataFrame) -> DataFrame:
    """(check, value, least, ok) of counted facts: rows of a table against what it should have, keys of a bundle against those wanted."""
    return facts.withColumn("ok", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)))


def missing_keys(have: DataFrame, wanted: Sequence[str], key: str = "key") -> DataFrame:
    """(key) of the wanted keys that aren't there."""
    listed = have.sparkSession.createDataFrame([(k,) for k in wanted], f"{key} string")
    return listed.join(have.select(key).distinct(), key, "left_anti")


def stale(files: DataFrame, before: str, after: str) -> DataFrame:
    """(stale): whether file `after` is older than `before`, by modification time."""
    t = lambda f: F.max(F.when(F.col("path") == f, F.col("modified")))
    return files.agg((t(after) < t(before)).alias("stale"))
