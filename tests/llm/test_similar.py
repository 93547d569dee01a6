"""The pipeline's near copies against brute-force Jaccard of five-word shingles."""

import random
import re

import pytest

import corpus_pipeline
from tessera.llm import simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Ids that are the least of their component."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s or {""}:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j in {j for x in s or {""} for j in where[x] if j > i}:
            if sets[j] == s or 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i for i in up if root(i) == i}


def test_near_copies_of_the_made_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == brute_kept(rows.items())
    assert 1 in kept and not {255, 770, 944} & kept  # similarity 0.83, 0.84 and 0.81, at 7 and 8 bits


@pytest.mark.parametrize(("small", "tile"), [(2, 1500), (24, 2_000_000)])
def test_chains_balls_and_odd_texts(spark, small, tile):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ABcdé") for _ in range(6))
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for size in (30, 200, 200):
        base = [word() for _ in range(size)]
        for _ in range(40):  # copies at similarities on both sides of 0.8
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                copy[rng.randrange(size)] = word()
            texts.append(rng.choice([" ", "\n"]).join(copy))
        for _ in range(12):  # each like the one before
            for _ in range(size // 60 or 1):
                base[rng.randrange(size)] = word()
            texts.append(" ".join(base))
    ids = rng.sample(range(1000), len(texts))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts)], SCHEMA).repartition(3)
    kept = simhash_dedup.one_of_each(df, similarity=(4, 5), small=small, tile=tile)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == brute_kept(list(zip(ids, texts)))
    assert simhash_dedup.one_of_each(df.limit(0), similarity=(4, 5)).count() == 0
