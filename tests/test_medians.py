"""Exact medians by selection, and how often their input is read."""

import math
import random
import statistics

import pytest

from tessera.operators import ordered


def order_of(v):
    return (math.isnan(v), v)


def median(values):
    s = sorted((v + 0.0 for v in values), key=order_of)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


def groups(seed=3):
    rng = random.Random(seed)
    made = {
        "spread": [rng.uniform(-1e3, 1e3) for _ in range(301)],
        "close": [1 + rng.random() * 1e-9 for _ in range(200)],
        "ties": [rng.choice([-1.0, -0.0, 0.0, 2.5]) for _ in range(100)],
        "one": [7.0],
        "two": [-3.0, 1e300],
        "odd": [math.inf, -math.inf, 5e-324, -5e-324, 0.0],
        "nan": [math.nan, 1.0, math.nan],
        None: [4.0, 6.0, 5.0],
    }
    rows = [(g, v) for g, values in made.items() for v in values] + [("spread", None), ("empty", None)]
    rng.shuffle(rows)
    return made, rows


@pytest.mark.parametrize("direct", [0, 50, 500_000])
def test_medians_are_exact(spark, direct):
    made, rows = groups()
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r["median"] for r in ordered.medians(df, "v", ["g"], direct=direct).collect()}
    want = {g: median(v) for g, v in made.items()}
    assert set(got) == set(want)
    assert all(got[g] == w or math.isnan(got[g]) and math.isnan(w) for g, w in want.items())
    assert got["spread"] == statistics.median(made["spread"])


def test_medians_without_groups_and_of_nothing(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(100)], "v int, w int")
    assert [r["median"] for r in ordered.medians(df, "v", []).collect()] == [49.5]
    assert ordered.medians(df.limit(0), "v", ["w"]).count() == 0
    assert sorted(r["m"] for r in ordered.medians(df, "v", ["w"], "m").collect()) == sorted(statistics.median([i for i in range(100) if i % 7 == k]) for k in range(7))


def test_keys_keep_order_of_doubles(spark):
    values = [-math.inf, -1e300, -2.0, -1.5, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, math.inf, math.nan]
    rows = ordered.keyed(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double"), "v", ["i"]).orderBy("i").collect()
    keys = [r["key_"] for r in rows]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_input_is_scanned_twice(spark, tmp_path):
    """Two scans of the table: one for the upper bits, one for the bins in question."""
    spark.range(20_000).selectExpr("id % 3 AS g", "rand(5) AS v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plans = []
    true = ordered.written
    try:
        ordered.written = lambda rows, step, *by: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), true(rows, step, *by))[1]
        ordered.medians(df, "v", ["g"])
    finally:
        ordered.written = true
    assert sum(p.count("Relation [g#") for p in plans) == 2, plans
