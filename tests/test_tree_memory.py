"""What png_tree's tasks hold doesn't grow with the number of images."""

import os
import tracemalloc
from collections import Counter

from pyspark.sql import functions as F

from tessera.plans import catalog_models
from tessera.sources import trees


def test_a_task_has_few_images(spark, tmp_path):
    plane = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i / 100).cast("float"))
    spark.range(12_000).select(F.col("id").alias("vec_id"), (F.col("id") % 2).cast("int").alias("label"), plane.alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = catalog_models.made_images(spark, str(tmp_path), 2).select("path", F.spark_partition_id().alias("p")).collect()
    assert len({r.path for r in rows}) == 12_000
    assert max(Counter(r.p for r in rows).values()) < 400


def test_a_writer_keeps_no_list_of_its_files(tmp_path, monkeypatch):
    class Task:
        partitionId = taskAttemptId = staticmethod(lambda: 0)

    monkeypatch.setattr(trees.TaskContext, "get", staticmethod(Task))
    writer = trees.TreeWriter({"path": str(tmp_path / "tree")})
    n, row = 3000, lambda i: {"name": f"{i:05d}" + "n" * 190, "content": b"x"}
    writer.write(map(row, range(2)))  # loads what it needs
    tracemalloc.start()
    message = writer.write(map(row, range(n)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400_000, peak
    writer.commit([message])
    assert len([f for f in os.listdir(tmp_path / "tree") if f[0] != "_"]) == n
    assert len(open(next((tmp_path / "tree" / "_manifest").iterdir())).readlines()) == n
