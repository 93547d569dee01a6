"""Grouped balance: whole groups, the same folds at any number of ranges, class shares near the best."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordered, splits


def made(kind, n=700, seed=1):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        size = {"singles": 1, "mixed": rng.choice([1, 1, 2, 5, 20]), "hot": 600 if g == 0 else rng.choice([1, 3])}[kind]
        share = rng.choice([0, 0.5, 1])
        rows += [(f"g{g}", int(rng.random() < share)) for _ in range(size)]
    return rows + [(None, 1), (None, 0)]


@pytest.mark.parametrize("kind", ["singles", "mixed", "hot"])
@pytest.mark.parametrize("full", [500_000, 40])
def test_folds_are_whole_and_near(spark, monkeypatch, kind, full):
    rows = made(kind)
    df = spark.createDataFrame(rows, "g string, label int").repartition(5)
    monkeypatch.setattr(ordered, "FULL", full)  # many ranges give the same folds as one
    got = splits.balanced_folds(df, "g", "label", 5).collect()
    assert len(got) == len(rows)
    fold = {}
    for r in got:
        assert fold.setdefault(r.g, r.fold) == r.fold and 0 <= r.fold < 5
    groups = {}
    for g, y in rows:
        groups.setdefault(g, [0, 0])[y] += 1
    u = {r.g: r.u for r in df.select("g").distinct().select("g", splits.draw(F.col("g")).alias("u")).collect()}
    order = sorted(groups, key=lambda g: (-groups[g][1], groups[g][0] if groups[g][1] % 2 == 0 else -groups[g][0], u[g], g is not None, g or ""))
    for i, g in enumerate(order):
        r = i % 10
        assert fold[g] == (r if r < 5 else 9 - r)
    ones = [sum(groups[g][1] for g in groups if fold[g] == k) for k in range(5)]
    largest = max(n1 for _, n1 in groups.values())
    assert max(ones) - min(ones) <= largest
    zeros = [sum(groups[g][0] for g in groups if fold[g] == k) for k in range(5)]
    assert max(zeros) - min(zeros) <= 2 * max(n0 for n0, _ in groups.values())


def test_three_parts(spark):
    df = spark.createDataFrame(made("mixed", 400), "g string, label int").repartition(3)
    got = splits.split_3way(df, "g")
    assert got.count() == df.count() and splits.leaks(got, "g").first()["leaking"] == 0
    n = {r.part: r["count"] for r in got.groupBy("part").count().collect()}
    assert abs(n["test"] / df.count() - 0.2) < 0.03 and abs(n["cal"] / df.count() - 0.16) < 0.03
    assert splits.balanced_folds(df.limit(0), "g", "label", 3).count() == 0
