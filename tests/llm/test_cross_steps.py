"""op12's chunks in step: the transducer over many stretches at once, encoding by runs of chunks, a table that keeps what is met often."""

import random

import numpy as np
import public_tokenizers

from tessera.llm import cross_tokens
from tests.llm.test_tokens import odd_texts

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def cut(rng, text, most):
    out = []
    while text:
        n = rng.randint(1, most)
        out.append(text[:n])
        text = text[n:]
    return out


def test_stretches_in_step_align_as_each_alone():
    rng = random.Random(3)
    pairs = [(cut(rng, t, 4), cut(rng, t, 6)) for t in (bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(500))]
    vocabs = [sorted({x for p in pairs for x in p[side]}) for side in (0, 1)]
    ids = [[[vocabs[side].index(x) for x in p[side]] for p in pairs] for side in (0, 1)]
    t = cross_tokens.Transducer(*vocabs, most=20)  # forgets between calls
    for some in (range(0, 500), range(100, 300), range(1), range(0)):
        a, b = ([ids[side][k] for k in some] for side in (0, 1))
        flat = [np.array([i for x in side for i in x], np.int64) for side in (a, b)]
        n = [np.array([len(x) for x in side], np.int64) for side in (a, b)]
        last_a, last_b, links, n_links = t.align_all(flat[0], n[0], flat[1], n[1])
        want = [cross_tokens.Transducer(*vocabs).align(x, y) for x, y in zip(a, b, strict=True)]
        assert links.tolist() == [x for _, found in want for x in found] and n_links.tolist() == [len(found) for _, found in want]
        for last, side, which in ((last_a, a, 0), (last_b, b, 1)):
            sizes = [[len(g.split("|")[which].split(",")) for g in groups] for groups, _ in want]
            assert np.flatnonzero(last).tolist() == [e - 1 for e in np.cumsum([s for x in sizes for s in x]).tolist()]


def test_chunks_are_encoded_by_runs():
    calls = []
    encoder = cross_tokens.ByteLevel(BYTES)
    quick = encoder.quick
    encoder.quick = lambda text: calls.append(text) or quick(text)
    chunks = [f" word{i}" for i in range(5000)] + [f" é{i}" for i in range(50)] + [" end.\n", " ", " tab\t", " " + "x" * 2000]
    order, ids, n = encoder.encode(chunks)
    assert sorted(order) == sorted(chunks) and len(calls) < 50
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [e.ids for e in encoder.library.encode_batch(order, add_special_tokens=False)]


def test_a_small_table_gives_the_same_blocks():
    texts = [t for t in odd_texts(5, 60) if t] + ["the cat sat on the mat " * 3] * 40

    def digests(aligner, at_once):
        out = []
        for i in range(0, len(texts), at_once):
            block = cross_tokens.Block(aligner)
            block.add(list(range(i, min(i + at_once, len(texts)))), texts[i : i + at_once])
            for batch in block.batches(0, cross_tokens.pa.int64()):
                out += [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")) for r in batch.to_pylist()]
        return out

    small = cross_tokens.Aligner(BYTES, PIECES, most=20, in_step=6)
    assert digests(small, 7) == digests(cross_tokens.Aligner(BYTES, PIECES), 1000)
    assert len(small.groups) <= 20 + len({c for t in texts[-7:] for c in cross_tokens.chunks_of(f" {t}")}) and " the" in small.table
    assert len(small.column("links")) == small.column("n_links").sum() and len(small.uses) == len(small.groups)
