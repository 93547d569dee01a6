"""Suffix-array and SimHash dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, simhash_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, k1 string"


def brute_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(rng, n=60):
    word = lambda: "".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(70) for _ in range(4)]
    docs = []
    for i in range(n):
        parts = [text(rng.randint(0, 60))]
        if i % 2:
            s = rng.choice(shared)
            a = rng.randint(0, 60)
            parts += [s[a : a + rng.randint(150, 400)], text(rng.randint(0, 30))]
        docs.append(" ".join(parts))
    return [*docs, docs[3], docs[3] + "x", None, "", "a" * 1200, "ab" * 400, "short", "short", shared[0] * 2]


@pytest.mark.parametrize(("bucket", "key_bits"), [(2, 64), (200, 3)])
def test_removal_is_that_of_brute_force(spark, bucket, key_bits):
    texts = passages(random.Random(5))
    rows = [(i, t, "x", "clash") for i, t in enumerate(texts)] + [(None, texts[5], None, None), (7, texts[7], None, None)]
    got = suffix_dedup.removal_digests(spark.createDataFrame(rows, SCHEMA).repartition(3), length=200, bucket=bucket, key_bits=key_bits).collect()
    want = [(r[0], *x) for r, x in zip(rows, brute_removal([r[1] for r in rows], 200))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("seed", range(4))
def test_small_alphabet_and_short_windows(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(25)] + ["ab" * 50]
    got = suffix_dedup.removal_digests(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA), length=20, gram=6, bucket=3 if seed % 2 else 500).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(brute_removal(texts, 20))


@pytest.mark.parametrize("bits", [0, 2, 64])
def test_bucket_of_colliding_hashes(monkeypatch, bits):
    """Windows of a bucket are those of brute force, whatever the hashes propose."""
    true = suffix_dedup.windows_hashes
    monkeypatch.setattr(suffix_dedup, "windows_hashes", lambda *a: true(*a) & np.uint64((1 << bits) - 1))
    rng = random.Random(bits)
    length, gram = 30, b"anchor"
    bank = ["".join(rng.choice("xy") for _ in range(24)).encode() for _ in range(4)]
    for size in (2, 40):
        group = np.array(sorted(rng.randrange(3) for _ in range(size)))
        made = {}
        while len(made) < size:
            before = (bytes([rng.choice(b"xy")]) + rng.choice(bank))[rng.randrange(1, 20) :]
            behind = rng.choice(bank)[: rng.randint(24 - len(before), 24)] if len(before) < 24 else rng.choice(bank)
            raw = before + gram + behind
            if len(raw) >= length:
                made.setdefault((raw, len(before)), None)
        raws, left = zip(*made)
        weight = np.array([rng.choice([1, 1, 2]) for _ in raws])
        got = {(i, w) for i, a, b in zip(*map(np.ndarray.tolist, suffix_dedup.repeated_windows(list(raws), np.array(left), weight, group, length))) for w in range(a, b - length + 1)}
        seen = Counter((g, left[i] - w, raws[i][w : w + length]) for i, g in enumerate(group) for w in range(len(raws[i]) - length + 1) if 0 <= left[i] - w <= length - len(gram))
        want = {(i, w) for i, g in enumerate(group) for w in range(len(raws[i]) - length + 1) if weight[i] == 1 and seen[g, left[i] - w, raws[i][w : w + length]] > 1}
        assert got == want


def test_anchors_of_equal_windows_in_short_and_long_texts():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 900).astype(np.uint8)
    long = np.concatenate([rng.integers(97, 123, 65_300).astype(np.uint8), shared, rng.integers(97, 123, 80_000).astype(np.uint8)])

    def offsets(data):
        place, gram, first, last = suffix_dedup.anchors(data, 200, 40)
        assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
        return np.repeat(place, last - first + 1) - np.arange(len(data) - 199), np.repeat(gram, last - first + 1)

    for a, b in zip(offsets(shared), offsets(long), strict=True):
        assert (a == b[65_300 : 65_300 + len(a)]).all()


def test_suffix_sort_orders_and_measures():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    start = rng.permutation(360)[:150]
    end = np.minimum(start + 40, 400)
    group = rng.integers(0, 3, 150)
    order, lcp = suffix_dedup.suffix_sort(data, start, end, group)
    raw = [(int(g), data[a:b].tobytes()) for g, a, b in zip(group, start, end)]
    assert [raw[i] for i in order] == sorted(raw)
    for i in range(1, len(order)):
        (g, x), (h, y) = raw[order[i - 1]], raw[order[i]]
        same = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert lcp[i] == (same if g == h else 0)


def test_cut_keeps_characters_columns_and_rows(spark):
    shared = "né漢" * 60
    rows = [(1, "é" + shared + "one", "fr", "c"), (2, "è" + shared + "two", None, None), (3, None, "x", "y"), (4, "clean text", "x", "y")]
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1].text == "éone" and out[2].text == "ètwo" and out[3].text is None and out[4].text == "clean text"
    assert out[1].k1 == "c"


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.removal_digests(none).count() == 0
    assert simhash_dedup.simhash_groups(none).count() == 0
    assert simhash_dedup.one_of_each(none).count() == 0


def brute_fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    comp = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 4 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return comp


def test_groups_are_those_of_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("ABCdefé") for _ in range(rng.randint(1, 5)))
    base = [[word() for _ in range(rng.choice([1, 3, 5, 200, 400]))] for _ in range(40)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n", "  "]).join(copy))
    texts += [None, "", " \t\n", texts[0], texts[0].lower()]
    order = list(range(1000, 1000 + len(texts)))
    rng.shuffle(order)
    rows = [(i, t, None, None) for i, t in zip(order, texts)]
    got = {r.doc_id: r for r in simhash_dedup.simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {i: brute_fingerprint(t) for i, t, _, _ in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints)
    kept = simhash_dedup.one_of_each(spark.createDataFrame(rows, SCHEMA), words=4).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute_components(prints).values()))


def test_grid_finds_all_close_pairs(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for _ in range(3):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            prints.add(q)
    for p in list(prints)[:2]:  # a dense ball: more in a cell than are compared pair by pair
        for b in range(64):
            prints.add(p ^ 1 << b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {tuple(sorted((signed(a), signed(b)))) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 4}
    got = {tuple(sorted((r.fa, r.fb))) for r in simhash_dedup.links(spark.createDataFrame([(signed(p),) for p in prints], "f long")).collect()}
    assert got <= want

    def roots(pairs):
        up = {signed(p): signed(p) for p in prints}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[max(top(a), top(b))] = min(top(a), top(b))
        return {x: top(x) for x in up}

    assert roots(got) == roots(want)


def test_spanning_links_of_a_ball():
    rng = np.random.default_rng(0)
    ball = np.unique(np.array([1 << int(b) for b in rng.integers(0, 64, 300)], np.uint64) ^ np.array([1 << int(b) for b in rng.integers(0, 64, 300)], np.uint64))
    a, b = simhash_dedup.spanning(ball, ball, 4)
    assert len(a) == len(ball) - 1 and (np.bitwise_count(a ^ b) <= 4).all()


def test_a_full_cell_is_cut_further():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 3, np.uint64)
    ball = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 150, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150, np.uint64)) for b in base]))
    high = ball >> np.uint64(1)
    even = np.uint64(simhash_dedup.EVEN)
    marks = ((ball | high) & even) | ((ball & high) & even) << np.uint64(1)
    a, b = simhash_dedup.within(ball, marks, 4, (1 << 64) - 1, full=20)
    assert (np.bitwise_count(a ^ b) <= 4).all()

    def groups(x, y):
        up = {p: p for p in ball.tolist()}

        def top(p):
            while up[p] != p:
                p = up[p]
            return p

        for p, q in zip(x.tolist(), y.tolist()):
            up[max(top(p), top(q))] = min(top(p), top(q))
        return {p: top(p) for p in up}

    assert groups(a, b) == groups(*simhash_dedup.spanning(ball, marks, 4))
    assert [simhash_dedup.spare_blocks(n) for n in (10, 1 << 24, (1 << 24) + 1, 1 << 30, 1 << 32)] == [3, 3, 4, 5, 6]


def test_near_dedup_of_repeated_and_null_rows(spark):
    rows = [(5, "a b c d e", "x", "y"), (5, "a b c d e", "x", "y"), (None, "a b c d e", None, None), (None, "other words are these here", None, None), (9, None, None, None)]
    kept = simhash_dedup.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "other words are these here"), (5, "a b c d e"), (9, "")]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 40)} | {500: 500, 501: 500}
    assert got == want


def test_spans_merge():
    assert suffix_dedup.merge_spans([(5, 9), (1, 3), (3, 4), (8, 12)]) == [(1, 4), (5, 12)]
    assert F is not None


@pytest.mark.parametrize("bits", [*range(9), 64])
def test_suffix_sort_under_colliding_hashes(monkeypatch, bits):
    """Whatever hashes propose, an order is a permutation, sorted by the bytes, with the bytes' own extensions."""
    true = suffix_dedup.windows_hashes
    monkeypatch.setattr(suffix_dedup, "windows_hashes", lambda *a: true(*a) & np.uint64((1 << bits) - 1))
    for seed in range(100):
        rng = np.random.default_rng(seed)
        data = rng.integers(97, 99, 200).astype(np.uint8)
        n = int(rng.integers(1, 60))
        start = rng.integers(0, 170, n)
        end = start + rng.integers(0, 31, n)
        group = rng.integers(0, 3, n)
        order, lcp = suffix_dedup.suffix_sort(data, start, end, group)
        raw = [(int(g), data[a:b].tobytes()) for g, a, b in zip(group, start, end)]
        assert sorted(order.tolist()) == list(range(n)) and [raw[i] for i in order] == sorted(raw)
        for i in range(1, n):
            (g, x), (h, y) = raw[order[i - 1]], raw[order[i]]
            assert lcp[i] == (next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))) if g == h else 0)


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5, 6, 7, 8])
def test_buckets_under_more_colliding_hashes(monkeypatch, bits):
    test_bucket_of_colliding_hashes(monkeypatch, bits)
