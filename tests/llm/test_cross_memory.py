"""op12's memory: what a block hands on is packed, tasks get few rows at a time, and nothing is kept or written that isn't needed."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from tessera.llm import common, cross_tokens

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_packed_numbers_come_back():
    rng = random.Random(1)
    numbers = [0, 127, 128, (1 << 14) - 1, 1 << 14, 1 << 21, 1 << 28, (1 << 35) - 1] + [rng.randrange(1 << rng.randint(0, 35)) for _ in range(3000)]
    for some in (numbers, numbers[:1], []):
        data, width = cross_tokens.packed(np.array(some, np.int64))
        assert cross_tokens.unpacked(data).tolist() == some and width.sum() == len(data)
        assert width.tolist() == [max(1, -(-n.bit_length() // 7)) for n in some]


def test_a_blocks_frequent_chunks_take_a_byte():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "mats"]) if rng.random() < 0.9 else f"w{rng.randrange(9000)}" for _ in range(200)) for _ in range(100)]
    block = cross_tokens.Block(cross_tokens.Aligner(BYTES, PIECES))
    block.add(list(range(100)), texts)
    (batch,) = block.batches(0, pa.int64())
    assert sum(map(len, batch.column("chunks").to_pylist())) < 1.3 * 20_000
    sizes, links = (cross_tokens.unpacked(np.frombuffer(batch.column(c)[0].as_py(), np.uint8)) for c in ("sizes", "links"))
    pairs, times = (np.array(batch.column(c)[0].as_py()) for c in ("pairs", "times"))
    assert sizes.sum() == len(links) and set(links.tolist()) == set(range(len(pairs))) and times.sum() == sum(batch.column("n_links").to_pylist())
    assert (np.diff(times) <= 0).all()


def test_tasks_get_few_rows_at_a_time_and_sums_are_not_written(spark, monkeypatch):
    before, steps, most = spark.conf.get(ROWS), [], []

    def written(df, step):
        steps.append(step)
        most.append(int(spark.conf.get(ROWS)))
        return common.written(df, step)

    monkeypatch.setattr(cross_tokens, "written", written)
    texts = ["the cat sat", None, "on the mat"] * 700
    got = cross_tokens.aligned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES, PIECES)
    assert steps == ["blocks"] and most == [500] and spark.conf.get(ROWS) == before
    assert got.count() == len(texts)
    assert "ShuffledHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_few_rows_at_a_time_end_with_the_step_and_never_raise_the_setting(spark):
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    rows, before = spark.range(0, 2500, 1, 1), spark.conf.get(ROWS)
    with common.small_batches(spark):
        assert [r.n for r in rows.mapInArrow(sizes, "n long").collect()] == [500] * 5
    spark.conf.set(ROWS, "100")
    try:
        with common.small_batches(spark):
            assert spark.conf.get(ROWS) == "100"
        assert spark.conf.get(ROWS) == "100"
    finally:
        spark.conf.set(ROWS, before)


def test_answers_forget_the_tokenizers():
    cross_tokens.aligner_of(BYTES, PIECES)
    block = cross_tokens.Block(cross_tokens._aligners[BYTES, PIECES])
    block.add([1, 2, 3], ["the cat sat", "", "the mat"])
    (batch,) = block.batches(0, pa.int64())
    n = len(batch.column("pairs")[0].as_py())
    answers = pa.table({"of": [0] * n, "place": range(n), "count": [2] * n, "best": [True] * n})
    out = cross_tokens._answered(pa.Table.from_batches([batch]), answers).to_pylist()
    assert not cross_tokens._aligners
    assert [(r["doc_id"], r["n_best"], r["count_sum"]) for r in out] == [(i, k, 2 * k) for i, k in zip((1, 2, 3), batch.column("n_links").to_pylist())] and out[1]["n_links"] == 0
