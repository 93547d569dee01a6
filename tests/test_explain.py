"""Sampled explanations: sums of a model of any kind, and the exact values of small ones."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models, splits


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 4))
    rows = [(i, v.tolist(), int(v[0] + v[1] * v[2] > 0)) for i, v in enumerate(x)]
    return models.with_vector(spark.createDataFrame(rows, "img int, f array<double>, label int")).cache()


@pytest.mark.parametrize("kind", ["logistic", "forest", "boosted"])
def test_sampled_contributions_add_up_for_any_model(spark, features, kind):
    pipeline = {"logistic": models.logistic(300), "forest": models.forest(8, 4), "boosted": models.boosted(10)}[kind]
    model = pipeline.fit(features)
    background = splits.exact_sample(features, "img", 50)
    got = models.sampled_contributions(model, features.where("img < 20").select("img", "f"), background, "img", 4)
    p = {r.img: r.p for r in models.scored(model, features).select("img", "p").collect()}
    mean = np.mean([p[r.img] for r in background.collect()])
    rows = got.collect()
    assert len(rows) == 20
    for r in rows:
        assert abs(r.base + sum(r.contributions) - p[r.img]) < 1e-9 and abs(r.base - mean) < 1e-9


def test_all_orders_give_shapley_values():
    rng = np.random.default_rng(1)
    background, own = rng.normal(0, 1, (7, 3)), rng.normal(0, 1, 3)
    scores = lambda x: 1 / (1 + np.exp(-(x[:, 0] * x[:, 1] + x[:, 2])))
    value = lambda s: scores(np.where(np.isin(np.arange(3), list(s)), own, background)).mean()
    want = [sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value({*s, f}) - value(s)) for k in range(3) for s in itertools.combinations([g for g in range(3) if g != f], k)) for f in range(3)]
    walks = [np.array(w) for w in itertools.permutations(range(3))]
    for cells in (1, 1 << 21):
        assert np.allclose(models.walked(scores, own, background, walks, cells), want)


def test_backgrounds_are_bounded(spark, features):
    model = models.logistic(300, 5).fit(features)
    with pytest.raises(ValueError):
        models.sampled_contributions(model, features, features, "img", 4)
    assert splits.exact_sample(features, "img", models.BACKGROUND).agg(F.count("*")).first()[0] == 200
