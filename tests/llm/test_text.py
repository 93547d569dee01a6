"""Mixing, pieces, language ID and the pipeline against brute force, the library and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import byte_cnn, mixing, pieces, queries
from tests.llm.test_similar import brute_kept

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def count_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Of each source its target: clamp, reshare, repeat."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, clamped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in clamped]
        if not rest:
            return clamped
        left, w = total - sum(clamped.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / w > most * sizes[s]]
        if not over:
            return clamped | {s: left * weight[s] / w for s in rest}
        clamped |= {s: most * sizes[s] for s in over}


def mixing_rows():
    rng = random.Random(3)
    rows = []
    for i in range(600):
        source = rng.choice(["a", "B", "é", None, "tiny", "漢"]) if i % 3 else "a"
        n = rng.choice([0, 1, 5, 80, 400]) if source != "tiny" else 1
        rows.append((i, rng.choice([" ", "\n", "  "]).join(["w"] * n) if n else rng.choice([None, "", "  "]), "en", source, 0))
    return [*rows, rows[10], (None, "one two", "en", "a", 0), (None, None, None, None, None)]


@pytest.mark.parametrize("buckets", [1, 16, 4096])
def test_mixture_meets_its_targets(spark, buckets):
    rows = mixing_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = mixing.mixed_counts(df, buckets=buckets).collect()
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + count_words(t)
    want = brute_targets(sizes)
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size + r.part
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 2, (s, n, want[s])
    again = mixing.mixed_counts(df.repartition(5), buckets=buckets).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixture_of_documents(spark):
    df = spark.createDataFrame(mixing_rows()[:600], DOCS)
    counts = {r.doc_id: r.copies for r in mixing.mixed_counts(df, partial=False).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: n for i, n in counts.items() if n}
    none = spark.createDataFrame([], DOCS)
    assert mixing.mixed_counts(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    empty = spark.createDataFrame([(1, None, None, "x", 0), (2, "", None, None, 0)], DOCS)
    assert {(r.target, r.taken) for r in mixing.mixed_counts(empty).collect()} == {(0.0, 0)}


def test_pieces_are_those_of_the_library(spark):
    path = queries.tokenizer(queries.PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(0)
    bits = [" ", "  ", "   ", "\n", "\t", "▁", "a", "é", "é", "漢字", "😀", "<s>", "</s>", "<0x41>", "\x00", "word", "ünïcode", " ", "　", "​", "%%%", "123", "�", "<unk>", "x" * 30]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += [None, "", " ", "  ", "▁", " ▁", "a ", " a", "z" * 20_000, ("ab " * 30_000), "a\n b"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, t2 string").repartition(3)
    for most in (5, 300_000):
        pieces._tables.clear()
        got = {r.doc_id: r for r in pieces.digests(df, path, most=most).collect()}
        for i, t in enumerate(texts):
            ids = sp.encode(t or "")
            assert got[i].n_tokens == len(ids), repr(t)
            assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), repr(t)
            assert got[i].decoded_sha256 == hashlib.sha256((sp.decode(ids) if ids else "").encode()).hexdigest(), repr(t)
    rows = pieces.decoded(pieces.encoded(df.select("doc_id", "text"), path), path).collect()
    assert {r.doc_id: r.text for r in rows} == {i: sp.decode(sp.encode(t)) if t else "" for i, t in enumerate(texts)}
    assert pieces.digests(df.limit(0), path).count() == 0


def test_a_small_table_is_dropped_and_refilled():
    table = pieces.ChunkTable(queries.tokenizer(queries.PIECES), most=3)
    sp = table.sp
    for text in ("one two three four", "five one two", "one " * 5 + "y" * 100, "three"):
        ids = [int(i) for c in table.encode([text])[0] for i in c[0].split(",")]
        assert ids == sp.encode(text)


def test_language_of_held_out_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    rows = queries.op5_language_id(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    for r in rows[:500]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    known = [r for r in held if docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in known) / len(known) > 0.98


def test_language_of_odd_texts(spark):
    rows = [(i, t, l, "s", 0) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("the house and the tree", "en"), ("das Haus und der Baum", "de"), (None, "en"), ("", "de"), (" 12 !?", None), ("x" * 100_000, None), ("漢字", None), ("\x00\x01", None)] * 3)]
    df = spark.createDataFrame(rows, DOCS)
    model = byte_cnn.fit(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in byte_cnn.identify(df.select("doc_id", "text"), model).collect()}
    assert {got[i] for i in (4, 5, 6, 9)} == {("und", 0.0)} and got[0][0] in ("en", "de") and got[8][0] in ("en", "de")
    kept = byte_cnn.known_language(df, model)
    assert kept.columns == df.columns and kept.where("text is null").count() == 0
    none = df.limit(0)
    assert byte_cnn.fit(none) is None and byte_cnn.identify(none.select("doc_id", "text"), None).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in byte_cnn.identify(unlabelled.select("doc_id", "text"), byte_cnn.fit(unlabelled)).collect()} == {"und"}
    same = byte_cnn.fit(df.repartition(5))
    assert all((a == b).all() for a, b in zip(model.tables, same.tables))


def test_windows_hold_every_byte():
    for n in (0, 1, 4, 255, 256, 257, 509, 510, 2000):
        raw = bytes(i % 251 + 1 for i in range(n))
        rows, new = byte_cnn.windows_of(raw, 256, 3)
        back = rows[0].tobytes() + b"".join(r[3:].tobytes() for r in rows[1:])
        assert back.rstrip(b"\0") == raw and (new > 0).all() and len(back) - n <= 256


def cut_repeats(texts, length=200):
    """Characters all of whose bytes are in a string of `length` bytes that occurs again."""
    seen = {}
    for k, t in enumerate(texts):
        raw = t.encode()
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], []).append((k, i))
    gone = [bytearray(len(t.encode())) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = b"\1" * length
    out = []
    for t, g in zip(texts, gone):
        at, kept = 0, []
        for ch in t:
            n = len(ch.encode())
            kept.append("" if all(g[at : at + n]) else ch)
            at += n
        out.append("".join(kept))
    return out


def test_pipeline_is_that_of_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    known = {r.doc_id: r for r in byte_cnn.identify(docs.select("doc_id", "text"), byte_cnn.fit(docs)).collect()}
    stay = {i for i, r in known.items() if r.lang_pred != "und" and r.score >= 0.4}
    stay = sorted(brute_kept((i, rows[i].text) for i in stay))
    text = dict(zip(stay, cut_repeats([rows[i].text for i in stay])))
    sizes = {}
    for i in stay:
        sizes[rows[i].source] = sizes.get(rows[i].source, 0) + count_words(text[i])
    want = brute_targets(sizes)
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer(queries.PIECES))
    got = corpus_pipeline.run(spark, SF).collect()
    copies, taken = {}, {}
    for r in got:
        ids = sp.encode(text[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.n_tokens == len(ids)
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for i, n in copies.items():
        taken[rows[i].source] = taken.get(rows[i].source, 0) + n * count_words(text[i])
    longest = {}
    for i in stay:
        longest[rows[i].source] = max(longest.get(rows[i].source, 0), count_words(text[i]))
    for s, target in want.items():
        assert abs(taken.get(s, 0) - target) <= longest[s] / 2 + 1
    assert max(copies.values()) <= 3


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near copies", "repeats", "mixture", "pieces"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes


@pytest.mark.parametrize("kind", ["empty", "nulls", "clash"])
def test_pipeline_of_odd_tables(spark, tmp_path, kind):
    """Empty and null-only tables, and further columns with names that stages use, end to end."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if kind == "empty":
        made = docs.limit(0)
    elif kind == "nulls":
        made = docs.limit(5).select(*(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes))
    else:
        made = docs.limit(40).withColumns({c: F.lit("x") for c in ("k1", "k2", "spans", "size", "tag", "id", "component", "lang_pred", "score", "t", "copies")})
    made.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    n = out.count()
    assert n == 0 if kind != "clash" else n > 0
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_probabilities_are_those_of_a_plain_convolution():
    rng = np.random.default_rng(5)
    samples = [bytes(rng.choice(list(b"abcde "), 90).tolist()) for _ in range(30)] + [bytes(rng.choice(list(b"vwxyz "), 90).tolist()) for _ in range(30)]
    model = byte_cnn.ByteCNN.train(samples, ["a"] * 30 + ["z"] * 30, window=64, epochs=2)

    def window(row):
        top = [max(sum(table[i][row[at + i]][f] for i in range(w)) for at in range(len(row) - w + 1)) for w, table in zip(model.widths, model.tables) for f in range(table.shape[2])]
        z = np.maximum(np.array(top) + model.bias, 0) @ model.out + model.out_bias
        e = np.exp(z - z.max())
        return e / e.sum()

    raw = samples[0] + samples[40] + b"tail"
    rows, share = byte_cnn.windows_of(raw, 64, max(model.widths) - 1)
    want = np.stack([window(r.tolist()) for r in rows])
    assert np.allclose(model.probabilities(rows, model.lookups()), want, atol=1e-5)
    step = 64 - (max(model.widths) - 1)
    assert [r.tolist() for r in rows] == [list(raw[i * step : i * step + 64].ljust(64, b"\0")) for i in range(len(rows))]
    assert share.sum() == len(raw) - (max(model.widths) - 1)


def test_every_label_is_learned(spark):
    rows = [(i, "αβγδ εζηθ " * 9 if i % 300 == 1 else f"plain words number {i} " * 5, f"l{i % 300}") for i in range(900)]
    model = byte_cnn.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_class=2, epochs=1)
    assert len(model.classes) > 250
    none = spark.createDataFrame([(1, "words", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    assert byte_cnn.fit(none) is None and [r.doc_id for r in byte_cnn.known_language(none, None).collect()] == [1]
