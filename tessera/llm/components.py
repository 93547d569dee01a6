"""Connected components by alternating stars, as joins and sums of Spark; one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Edges from which a hot node could hold a task up.
MANY = 5_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the smallest node reachable.

    Each round hangs every larger neighbour of a node on the node's smallest neighbour, then every
    smaller one and the node itself (large star, small star), until a round changes nothing: a
    logarithmic number of rounds, none of which makes more edges than there were. Stars never gather
    a node's neighbours in one place; only their minimum is computed, in part before the shuffle.
    """
    steps: list[DataFrame] = []

    def step(df: DataFrame, name: str) -> DataFrame:
        """Above MANY edges sums are written before they are joined: a join right above a sum can't split its hot keys."""
        if many:
            steps.append(df := written(df, name))
        return df

    now = written(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct(), "edges")
    n = now.count()
    before, many = None, n > MANY
    if not n:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = step(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = step(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = step(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        after = written(small, "edges")
        state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        for old in (now, *steps):
            dropped(old)
        steps.clear()
        now = after
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components haven't settled in {rounds} rounds")
