"""Tags among chosen ones: rows are looked up, not sorted, and a task holds a bounded number of tags."""

import pytest

from tessera.operators import splits

ROWS = [(i, None if i % 11 == 0 else 7 if i % 3 == 0 else i % 400) for i in range(3000)]
CHOSEN = [(t,) for t in [*range(0, 400, 2), 7, 7, 7, 10, None, 5000]]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [1000, 5])
def test_marks_are_those_of_a_set(spark, small):
    rows, chosen = spark.createDataFrame(ROWS, "id long, tag long"), spark.createDataFrame(CHOSEN, "t long")
    want = {t for (t,) in CHOSEN} - {None}
    got = splits.marked(rows, "tag", chosen, "inside", small=small)
    assert got.columns == ["id", "tag", "inside"]
    assert sorted(map(tuple, got.collect())) == [(i, t, t in want) for i, t in ROWS]
    assert ("BroadcastHashJoin" in plan(got)) == (small > 5)
    assert {r.inside for r in splits.marked(rows, "tag", chosen.limit(0), "inside", small=small).collect()} == {False}


@pytest.mark.parametrize("chosen", [[7, 12], []])
def test_lists_too(spark, chosen):
    rows = spark.createDataFrame(ROWS, "id long, tag long")
    inside, others = splits.among(rows, "tag", chosen)
    assert sorted(r.id for r in inside.collect()) == [i for i, t in ROWS if t in chosen] and inside.columns == others.columns == rows.columns
    assert inside.count() + others.count() == len(ROWS)


def test_many_tags_are_dealt_out_and_no_row_is_sorted(spark):
    rows, chosen = spark.range(20_000).withColumnRenamed("id", "tag"), spark.range(0, 240_000, 2)
    inside, others = splits.among(rows, "tag", chosen)
    for part in (inside, others):
        assert "ShuffledHashJoin" in plan(part) and "Sort " not in plan(part) and "SortMergeJoin" not in plan(part)
        assert part.count() == 10_000
    dealt = splits.marked(rows, "tag", chosen, "inside", held=10_000)
    assert "hashpartitioning(tag" in plan(dealt).replace("#", "(").replace("((", "(") and ", 12), REPARTITION_BY_NUM" in plan(dealt)
    assert dealt.where("inside").count() == 10_000
