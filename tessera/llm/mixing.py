"""Mixing sources to target weights by capped water-filling.

Every source has a size (its words), a weight and a cap (`most_epochs` times its size). Targets share
the total by weight; sources over their cap are clamped to it and the excess goes to the others by
weight, again and again until none is over. A source's target over its size is its number of epochs:
the whole part is taken of every document, the rest of documents in the order of a seeded hash until
the target is met. At most one document a source is taken in part (`partial`), or else rounded.

Nothing of a source is gathered: sizes are summed by hash bucket, which finds the bucket where a
target is met; only that bucket, one of `buckets`, is put in order. Null texts are empty and have size 0; null
sources are a source of their own, last in order. Equal rows are taken alike (they tie in the hash
order, then by size, id and the text's hash), so reruns agree. Only sizes and hashes of texts are shuffled, so long texts
cost nothing but their reading; an empty table gives none; other columns don't matter, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, text_or_empty, written


def words(text: str | Column) -> Column:
    """Number of words."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def water_filling(sources: DataFrame, total: float, most_epochs: float = 3.0) -> DataFrame:
    """sources (with size, weight) with a column target: shares of total by weight, capped at most_epochs x size, the excess reshared.

    sources has one row a source. Each round is a sum over all sources; only totals come to the driver.
    """
    cap = F.col("size") * F.lit(float(most_epochs))
    level, before = None, -1
    while True:
        # At water level l a source gets l x weight or, if that is above its cap, its cap.
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        got = sources.agg(F.sum(F.when(full, cap)).alias("clamped"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if not got["open"] or got["n"] == before:
            break
        before = got["n"]
        level = (float(total) - float(got["clamped"] or 0.0)) / float(got["open"])
    level = F.lit(float("inf") if level is None or not got["open"] else level)
    return sources.withColumn("target", F.least(F.col("weight") * level, cap).cast("double"))


def cycled_weights(sizes: DataFrame, source: str, weights=(1.0, 2.0, 3.0)) -> DataFrame:
    """sizes with weight: the given ones, repeating, in order of the source's code points, null last. One row a source, so one window over them."""
    at = (F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1) % len(weights)
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at.cast("int") + 1))


def mix(rows: DataFrame, doc_id: str = "doc_id", source: str = "source", weights=(1.0, 2.0, 3.0), most_epochs: float = 3.0, seed: int = 42, partial: bool = True, buckets: int = 4096) -> DataFrame:
    """rows (doc_id, source, size and more) with source_size, target, copies (whole repetitions), part (words of one more, 0 mostly) and taken."""
    have = rows.columns
    draw = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col("size"))
    rows = rows.withColumns({"draw": draw, "slot": F.pmod(draw, F.lit(buckets)).cast("int")})
    slots = written(rows.groupBy(source, "slot").agg(F.sum("size").alias("slot_size")), "slots")
    sizes = slots.groupBy(source).agg(F.sum("slot_size").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    plan = water_filling(cycled_weights(sizes, source, weights), total, most_epochs)
    epochs = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    plan = plan.withColumns({"whole": F.floor(epochs + 1e-12).cast("long")}).withColumn("need", F.greatest(F.round(F.col("target") - F.col("whole") * F.col("size")), F.lit(0)).cast("long"))
    plan = written(plan.withColumnRenamed("size", "source_size").drop("weight"), "plan")
    # The slot in which the need of a source is met: those before it are taken once more.
    by = Window.partitionBy(source).orderBy("slot")
    ahead = slots.join(F.broadcast(plan) if plan.limit(10_001).count() <= 10_000 else plan, slots[source].eqNullSafe(plan[source])).drop(plan[source])
    ahead = ahead.withColumn("ahead", F.sum("slot_size").over(by) - F.col("slot_size"))
    ahead = written(ahead.select(F.col(source).alias("s_source"), F.col("slot").alias("s_slot"), "source_size", "target", "whole", "need", "ahead", (F.col("ahead") + F.col("slot_size")).alias("upto")), "ahead")
    out = rows.join(ahead, F.col(source).eqNullSafe(F.col("s_source")) & (F.col("slot") == F.col("s_slot")))
    split = (F.col("ahead") < F.col("need")) & (F.col("need") < F.col("upto"))
    order = Window.partitionBy(source, "slot").orderBy("draw", "size", doc_id, *(["tag"] if "tag" in have else [])).rowsBetween(Window.unboundedPreceding, -1)
    cut = out.where(split).withColumn("left", F.col("need") - F.col("ahead") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    rest = out.where(~split).withColumn("left", F.when(F.col("upto") <= F.col("need"), F.col("size")).otherwise(F.lit(0)))
    out = rest.unionByName(cut).withColumn("extra", F.least("size", F.greatest("left", F.lit(0))))
    if not partial:
        out = out.withColumn("extra", F.when(F.col("extra") * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)))
    one_more = (F.col("extra") == F.col("size")) & (F.col("size") > 0)
    out = out.withColumns({"copies": F.col("whole") + one_more.cast("long"), "part": F.when(one_more, F.lit(0)).otherwise(F.col("extra")).cast("long")})
    return out.withColumn("taken", (F.col("copies") * F.col("size") + F.col("part")).cast("long")).select(*have, "source_size", "target", "taken", "copies", "part")


def mixed_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """A row a document: doc_id, source, size, tag (a hash of the text), source_size, target, taken, copies, part."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"), F.xxhash64(text).alias("tag"))
    return mix(written(rows, "sizes"), "doc_id", "source", **how)


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixture itself: rows of docs, each as often as the mix takes it, whole texts only (the last document of a source is rounded, not cut)."""
    n, other, tag = fresh(docs, "mix_copies"), fresh(docs, "mix_id"), fresh(docs, "mix_tag")
    counts = mixed_counts(docs, doc_id, text, source, partial=False, **how).where("copies > 0")
    counts = counts.groupBy(F.col("doc_id").alias(other), F.col("source").alias(f"{other}_source"), F.col("tag").alias(tag)).agg(F.max("copies").cast("int").alias(n))
    same = F.col(doc_id).eqNullSafe(F.col(other)) & F.col(source).eqNullSafe(F.col(f"{other}_source")) & (F.xxhash64(text) == F.col(tag))
    return docs.join(counts, same).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(n)).drop(n)
