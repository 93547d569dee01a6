"""Models over feature vectors: fitting, calibration and its choice, explanations, evidence."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import metrics
from .boosting import Boosting, HistogramModel, Rules
from .splits import balanced_folds


#: Fixed value: rows of a background for explanations, at most.
BACKGROUND = 200


def with_vector(features: DataFrame, f: str = "f") -> DataFrame:
    return features.withColumn("features", array_to_vector(F.col(f)))


class Even:
    """A pipeline whose rows are first dealt to one partition a core, by their hash.

    A step of a forest makes and sends the statistics of all open nodes from each partition, be it of one row, and a single file may be a
    single partition. What the rows' plan left doesn't matter then, for the time or for the rows that trees draw.
    """

    def __init__(self, *stages):
        self.pipeline = Pipeline(stages=list(stages))

    def fit(self, rows: DataFrame) -> PipelineModel:
        n = rows.sparkSession.sparkContext.defaultParallelism
        hashed = rows.select("label", "features").withColumn("hash_", F.xxhash64("label", vector_to_array("features")))
        even = hashed.repartition(n, "hash_").sortWithinPartitions("hash_").drop("hash_").cache()
        try:
            return self.pipeline.fit(even)
        finally:
            even.unpersist()


def logistic(n: int, iterations: int = 2000) -> Even:
    """Standardised, with the penalty 1 / n."""
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Even(scale, LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=iterations, regParam=1 / max(n, 1), standardization=False))


def forest(trees: int = 300, depth: int = 10, seed: int = 42) -> Even:
    return Even(RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed))


def boosted(rounds: int = 100, depth: int | None = None, rate: float = 0.1, leaves: int = 31, least: int = 20) -> Boosting:
    """Histogram boosting, leaf by leaf."""
    return Boosting(Rules(rounds, leaves, least, rate, depth))


def scored(model: PipelineModel | HistogramModel, rows: DataFrame) -> DataFrame:
    """rows with p, the probability of class 1."""
    if isinstance(model, HistogramModel):
        return model.scored(rows)
    out = model.transform(rows)
    return out.select(*rows.columns, vector_to_array("probability")[1].alias("p"))


class Calibrated:
    """A map from scores to probabilities: none, isotonic or sigmoid, fitted on a held-out slice."""

    def __init__(self, kind: str, slice_: DataFrame | None = None, p: str = "p", y: str = "y"):
        self.kind, self.p = kind, p
        if kind == "isotonic":
            rows = slice_.select(F.col(p).alias("p_"), F.col(y).cast("double").alias("label"))
            self.model = IsotonicRegression(featuresCol="p_").fit(rows)
            self.x, self.v = (np.array(m.toArray()) for m in (self.model.boundaries, self.model.predictions))
        elif kind == "sigmoid":
            rows = VectorAssembler(inputCols=["z"], outputCol="features").transform(slice_.select(self._logit(F.col(p)).alias("z"), F.col(y).cast("double").alias("label")))
            fitted = LogisticRegression(maxIter=200).fit(rows)
            self.a, self.b = float(fitted.coefficients[0]), float(fitted.intercept)
        elif kind != "none":
            raise ValueError(kind)

    @staticmethod
    def _logit(p):
        q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(q / (1 - q))

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows with p replaced."""
        if self.kind == "none":
            return rows
        if self.kind == "sigmoid":
            return rows.withColumn(self.p, 1 / (1 + F.exp(-(self.a * self._logit(F.col(self.p)) + self.b))))
        out = self.model.transform(rows.withColumn("p_", F.col(self.p)))
        return out.withColumn(self.p, F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))).drop("p_", "prediction")


KINDS = ("none", "isotonic", "sigmoid")


def choose_calibration(slice_: DataFrame, group: str, bins: int = 15, seed: int = 42, y: str = "y") -> tuple[str, DataFrame]:
    """(the kind with the least calibration error on a held-out part of the slice, all errors); ties go to the simpler kind."""
    halves = balanced_folds(slice_, group, y, 2, seed)
    fit_on, test_on = halves.where("fold = 1").drop("fold"), halves.where("fold = 0").drop("fold")
    trials = None
    for i, kind in enumerate(KINDS):
        one = metrics.calibration_error(Calibrated(kind, fit_on).apply(test_on), bins).select(F.lit(i).alias("place"), F.lit(kind).alias("kind"), "ece")
        trials = one if trials is None else trials.unionByName(one)
    best = trials.agg(F.min_by("kind", F.struct(F.round("ece", 12), "place"))).first()[0]
    return best, trials


def importances(model: PipelineModel, width: int, spark) -> DataFrame:
    """(col0, importance) of a tree ensemble."""
    values = model.importances() if isinstance(model, HistogramModel) else model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(i, float(values[i])) for i in range(width)], "col0 int, importance double")


def top_importances(importances_: DataFrame, k: int = 20) -> DataFrame:
    """(rank, col0, importance) of the k largest, ties by column."""
    order = Window.orderBy(F.desc("importance"), "col0")  # a row a column of the layout
    return importances_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("rank", "col0", "importance")


# ---------------------------------------------------------------- exact explanations


def linear_contributions(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with base and contributions (array): the margin of a standardised logistic regression, term by term."""
    scale, lr = model.stages
    w = lr.coefficients.toArray() / np.where(scale.std.toArray() > 0, scale.std.toArray(), 1)
    w = np.where(scale.std.toArray() > 0, w, 0)
    m = scale.mean.toArray()
    weights, means = (F.array(*(F.lit(float(v)) for v in a)) for a in (w, m))
    shifted = F.zip_with(vector_to_array("features"), means, lambda x, c: x - c)
    return rows.withColumns({"base": F.lit(float(lr.intercept)), "contributions": F.zip_with(shifted, weights, lambda x, c: x * c)})


def exported_trees(model: PipelineModel) -> list[tuple[float, list[tuple]]]:
    """(weight, nodes) of each tree; a node is (feature, threshold, left, right, value, cover). Categorical splits don't occur."""
    if isinstance(model, HistogramModel):
        return model.exported()
    ensemble = model.stages[-1]
    out = []
    for tree, weight in zip(ensemble.trees, ensemble.treeWeights, strict=True):
        nodes: list[tuple] = []

        def walk(node, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append(())
            cover = float(node.impurityStats().count())
            if node.numDescendants():
                left, right = walk(node.leftChild()), walk(node.rightChild())
                split = node.split()
                nodes[at] = (split.featureIndex(), split.threshold(), left, right, 0.0, cover)
            else:
                stats = node.impurityStats()
                nodes[at] = (-1, 0.0, -1, -1, float(stats.stats()[1] / max(cover, 1e-12)), cover)
            return at

        walk(tree._call_java("rootNode"))
        out.append((weight / len(ensemble.trees), nodes))
    return out


def leaves_of(nodes: list[tuple]) -> list[tuple]:
    """(value, features, lower limits, upper limits, shares) of each leaf: a row reaches it if each feature is in (lower, upper];
    a feature that isn't known goes that way with its share of the covers."""
    out = []
    todo: list[tuple[int, dict]] = [(0, {})]
    while todo:
        at, path = todo.pop()
        f, limit, left, right, value, cover = nodes[at]
        if f < 0:
            lo, hi, share = zip(*path.values(), strict=True) if path else ((), (), ())
            out.append((value, np.array(list(path), np.int64), np.array(lo), np.array(hi), np.array(share)))
            continue
        lo, hi, share = path.get(f, (-np.inf, np.inf, 1.0))
        part = [nodes[child][5] / max(cover, 1e-12) for child in (left, right)]
        todo.append((right, path | {f: (max(lo, limit), hi, share * part[1])}))
        todo.append((left, path | {f: (lo, min(hi, limit), share * part[0])}))
    return out


def tree_values(nodes: list[tuple], x: np.ndarray) -> tuple[float, np.ndarray]:
    """(expected value, Shapley values rows x features) of one tree for the rows of x, exact over the tree's own covers."""
    return leaf_values(leaves_of(nodes), x)


def leaf_values(leaves: list[tuple], x: np.ndarray) -> tuple[float, np.ndarray]:
    """tree_values() of a tree's leaves, a leaf at a time over all rows.

    Each feature on a leaf's path multiplies the leaf's weight by 0 or 1 if it is known and by its share if it
    isn't. The mean over all orders of the features follows from the coefficients of a product of linear
    polynomials, one for each feature; it depends on a row only by which features lead to the leaf.
    """
    phi, expected = np.zeros(x.shape), 0.0
    for value, features, lo, hi, share in leaves:
        n = len(features)
        expected += value * float(np.prod(share))
        if not n or not len(x):
            continue
        part = x[:, features]
        leads = (part > lo) & (part <= hi)
        bits = np.arange(n)
        patterns, which = np.unique(leads @ (1 << bits), return_inverse=True)  # a path has fewer than 63 features
        known = (patterns[:, None] >> bits & 1).astype(np.float64)
        weights = np.array([1.0 / (n * math.comb(n - 1, s)) for s in range(n)])
        values = np.empty((len(known), n))
        for i in range(n):
            poly = np.zeros((len(known), n))  # poly[:, s]: sum over sets of s other features
            poly[:, 0] = 1
            for j in range(n):
                if j != i:
                    grown = poly * share[j]
                    grown[:, 1:] += poly[:, :-1] * known[:, j : j + 1]
                    poly = grown
            values[:, i] = value * (poly @ weights) * (known[:, i] - share[i])
        phi[:, features] += values[which.ravel()]
    return expected, phi


def _explained(start: float, trees: list, rest: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest_ = [(w, leaves_of(nodes)) for w, nodes in trees]
        for b in batches:
            if not len(b):
                continue
            x = np.stack([np.asarray(v, np.float64) for v in b["f"]])
            base, values = start, np.zeros(x.shape)
            for w, leaves in forest_:
                expected, phi = leaf_values(leaves, x)
                base += w * expected
                values += w * phi
            yield b[rest].assign(base=base, contributions=list(values))

    return run


def tree_contributions(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows, but for vector columns, with base and contributions of a tree ensemble: log-odds for boosted trees, probability for a forest."""
    plain = [f for f in rows.schema if f.dataType.typeName() != "udt"]
    schema = T.StructType([*plain, T.StructField("base", T.DoubleType()), T.StructField("contributions", T.ArrayType(T.DoubleType()))])
    names = [f.name for f in plain]
    start = model.start if isinstance(model, HistogramModel) else 0.0
    return rows.select(*names).mapInPandas(_explained(start, exported_trees(model), names), schema)


def numpy_scores(model: PipelineModel | HistogramModel) -> Callable[[np.ndarray], np.ndarray]:
    """The probability of class 1 for rows of a matrix, as a function that tasks can take along."""
    if isinstance(model, HistogramModel):
        return lambda x: 1 / (1 + np.exp(-model.margins(x)))
    last = model.stages[-1]
    if hasattr(last, "trees"):
        trees = [(w, np.array(nodes)) for w, nodes in exported_trees(model)]

        def votes(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(x))
            for weight, nodes in trees:
                at = np.zeros(len(x), np.int64)
                while (inner := np.flatnonzero(nodes[at, 0] >= 0)).size:
                    here = nodes[at[inner]]
                    at[inner] = np.where(x[inner, here[:, 0].astype(np.int64)] <= here[:, 1], here[:, 2], here[:, 3]).astype(np.int64)
                out += weight * nodes[at, 4]
            return out

        return votes
    scale = model.stages[0]
    std = scale.std.toArray()
    weights, start = np.where(std > 0, last.coefficients.toArray() / np.where(std > 0, std, 1), 0.0), float(last.intercept)
    start -= float(scale.mean.toArray() @ weights)
    return lambda x: 1 / (1 + np.exp(-(x @ weights + start)))


def walked(scores: Callable[[np.ndarray], np.ndarray], own: np.ndarray, background: np.ndarray, walks: list[np.ndarray], cells: int = 1 << 21) -> np.ndarray:
    """What each feature adds for one row: along each walk over the features its values replace the background's, in blocks of some steps x background."""
    width, n = len(own), len(background)
    out, some = np.zeros(width), max(1, cells // (n * width))
    for walk in walks:
        place = np.empty(width, np.int64)
        place[walk] = np.arange(width)  # when each feature is replaced
        means = np.concatenate([
            scores(np.where((place < np.arange(a, min(a + some, width + 1))[:, None])[:, None, :], own, background).reshape(-1, width)).reshape(-1, n).mean(axis=1)
            for a in range(0, width + 1, some)
        ])
        out[walk] += np.diff(means)
    return out / len(walks)


def sampled_contributions(model: PipelineModel | HistogramModel, rows: DataFrame, background: DataFrame, key: str, width: int, orders: int = 4, seed: int = 42) -> DataFrame:
    """(key, base, contributions): what each feature adds to the probability, for a model of any kind.

    Along `orders` seeded orders of the features, each forth and back, the row's values replace those of the background's rows
    one by one, and the mean probability's steps are the contributions. They add up to the row's probability less the
    background's mean. The background, BACKGROUND rows at most (exact_sample() draws them), goes to every task.
    """
    few = background.select("f").limit(BACKGROUND + 1).collect()
    if len(few) > BACKGROUND:
        raise ValueError(f"draw a background of {BACKGROUND} rows at most")
    other, scores = np.array([r.f for r in few], np.float64), numpy_scores(model)
    walks = [np.random.default_rng(seed + i).permutation(width) for i in range(orders)]
    walks += [w[::-1] for w in walks]
    base = float(scores(other).mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [walked(scores, np.array(f, np.float64), other, walks) for f in b.column("f").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([base] * len(b), pa.float64()), pa.array(found, pa.list_(pa.float64()))], [key, "base", "contributions"])

    kind = rows.schema[key].dataType.simpleString()
    spread = rows.select(key, "f").repartition(rows.sparkSession.sparkContext.defaultParallelism)  # a row takes long, whatever its size
    return spread.mapInArrow(run, f"`{key}` {kind}, base double, contributions array<double>")


def contributions(model: PipelineModel, rows: DataFrame, background: DataFrame, key: str, width: int) -> DataFrame:
    """(key, base, contributions, space): exact for trees (`logit` for boosted ones), sampled in probability for other models."""
    boosted_ = isinstance(model, HistogramModel)
    if boosted_ or hasattr(model.stages[-1], "trees"):
        space = "logit" if boosted_ else "probability"
        return tree_contributions(model, rows.select(key, "f")).select(key, "base", "contributions", F.lit(space).alias("space"))
    return sampled_contributions(model, rows, background, key, width).withColumn("space", F.lit("probability"))


def ledger(rows: DataFrame, k: int = 8) -> DataFrame:
    """rows with top (the k largest contributions by size: col0 and value), top_sum, rest_sum, total (base and all)."""
    pairs = F.transform("contributions", lambda v, i: F.struct((-F.abs(v)).alias("size"), i.alias("col0"), v.alias("value")))
    top = F.slice(F.array_sort(pairs), 1, k)
    total = F.aggregate("contributions", F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("top", F.transform(top, lambda t: F.struct(t["col0"].alias("col0"), t["value"].alias("value"))))
    rows = rows.withColumn("top_sum", F.aggregate("top", F.lit(0.0), lambda s, t: s + t["value"]))
    return rows.withColumns({"rest_sum": total - F.col("top_sum"), "total": F.col("base") + total})


def class_evidence(long: DataFrame, reference: DataFrame, key: str = "img_id", k: int = 8) -> DataFrame:
    """(key, rank, col0, nearer, distance_real, distance_ai): the k columns that speak loudest among the reference's, by distances to the class means in pooled deviations."""
    rows = long.join(reference.select("col0", "mean_0", "mean_1", "pooled"), "col0")
    to0, to1 = (F.abs(F.col("x") - F.col(f"mean_{c}")) / F.col("pooled") for c in (0, 1))
    rows = rows.select(key, "col0", to0.alias("distance_real"), to1.alias("distance_ai"))
    gap = F.round(F.abs(F.col("distance_real") - F.col("distance_ai")), 9)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(gap.desc(), "col0"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("nearer", F.when(F.col("distance_ai") < F.col("distance_real"), "AI").otherwise("real"))
