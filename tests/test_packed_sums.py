"""Boosting over a large table: tasks send a node's sums packed, from blocks of rows, and the table has a file a core at most."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import boosting as bo
from tessera.plans import catalog

WIDTH = 70


@pytest.fixture
def batch():
    rng = np.random.default_rng(0)
    bins = rng.integers(0, 256, (500, WIDTH)).astype(np.uint8)
    columns = pa.array([r.tobytes() for r in bins], pa.binary()), pa.array(rng.integers(0, 2, 500), pa.int32()), pa.array(rng.integers(0, 3, 500), pa.int32())
    return pa.RecordBatch.from_arrays(list(columns), ["bins", "y", "fold"])


def sums(rows: list[pa.RecordBatch], node: int) -> np.ndarray:
    parts = {r["part"]: r["sums"] for b in rows for r in b.to_pylist() if r["node"] == node}
    return np.concatenate([np.frombuffer(parts[i], np.int64).reshape(-1, bo.BINS, 3) for i in sorted(parts)])


def test_a_task_sends_a_few_rows_a_node_and_they_hold_every_cell(batch):
    bins, y, fold = bo._unpacked(batch, WIDTH)
    blocks = [b for part in (batch[:200], batch[200:]) for b in bo._blocks([0.3, -0.2], WIDTH)(iter([part]))]
    tree = np.array([(3, 90, 1, 2), (-1, 0, -1, -1), (-1, 0, -1, -1)], np.int64)
    job = (1, 2, [], tree, [1, 2])
    g, h = bo.gradients(np.full(500, -0.2), y)
    mine = fold != 2
    want = bo.histograms(bins[mine], g[mine], h[mine], bo.reached(tree, bins[mine]), [1, 2])
    for waiting in (1, bo.WAITING):
        got = list(bo._cells([job], WIDTH, waiting)(iter(blocks)))
        assert sum(map(len, got)) == 2 * -(-WIDTH // bo.TOGETHER)
        assert all((sums(got, node) == want[i]).all() for i, node in enumerate((1, 2)))


def test_partial_sums_are_added_up():
    rng = np.random.default_rng(1)
    parts = rng.integers(-(2**60), 2**60, (3, 12))
    table = pa.table([*(pa.array([v] * 3, pa.int32()) for v in (0, 5, 1)), pa.array([p.tobytes() for p in parts], pa.binary())], ["job", "node", "part", "sums"])
    got = bo._added(tuple(pa.scalar(v, pa.int32()) for v in (0, 5, 1)), table).to_pylist()
    assert [(r["job"], r["node"], r["part"]) for r in got] == [(0, 5, 1)] and (np.frombuffer(got[0]["sums"], np.int64) == parts.sum(axis=0)).all()


def test_steps_read_a_file_a_core_at_most(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, int(x[0] > 0), x.tolist()) for i, x in enumerate(rng.normal(size=(300, 3)))], "id long, label int, f array<double>")
    seen, write = [], bo.written

    def caught(df, step, *by):
        seen.append(df.rdd.getNumPartitions())
        return write(df, step, *by)

    monkeypatch.setattr(bo, "written", caught)
    rules = bo.Rules(rounds=3, leaves=4, least=10)
    far = bo.fit(rows.repartition(60), rules=rules, in_task=0, every=1)[-1]
    assert len(seen) == 4 and max(seen) <= spark.sparkContext.defaultParallelism
    assert far.trees == bo.fit(rows, rules=rules)[-1].trees


def test_images_are_measured_in_the_task_that_makes_them(spark):
    plan = catalog.QUERIES["extract230"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") == 1 and "data#" not in plan
