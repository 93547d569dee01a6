"""The similarity mode goes through the fingerprints' grid too, and lets the sets decide."""

import random

from tessera.llm import simhash_dedup
from tessera.llm.shingles import fingerprint

SCHEMA = "doc_id long, text string"


def test_links_of_the_grid_are_kept_without_any_sample(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(3000)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join([*base[:-2], "two", "more"]), " ".join(base[::-1])]
    prints = [fingerprint(t.encode(), 5) for t in texts]
    assert max((prints[0] ^ p).bit_count() for p in prints[1:3]) <= 4 < (prints[0] ^ prints[3]).bit_count()
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    # one sample of so many shingles that no two different texts share it
    got = simhash_dedup.one_of_each(docs, words=5, similarity=(4, 5), samples=1, rows=30_000)
    assert sorted(r.doc_id for r in got.collect()) == [0, 3]


def test_the_sets_decide_on_links_of_the_grid(spark):
    texts = ["a b c d e " * 100 + " ".join(f"{c}{i}" for i in range(6)) for c in "xy"]  # repeats make the fingerprint, not the set
    assert fingerprint(texts[0].encode(), 5) == fingerprint(texts[1].encode(), 5)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert simhash_dedup.one_of_each(docs, words=5, similarity=(4, 5)).count() == 2
