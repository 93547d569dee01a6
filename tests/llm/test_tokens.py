"""Token counts and cross-tokenizer alignment against the libraries and brute force over byte offsets."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import cross_tokens, token_counts

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_bytes string, N_A int"
LETTERS = [*"aabeest  \n\t.,'-_!<|>12", "　", " ", "é", "漢", "字", "🙂", "​", "\u0085", "\x1c", "▁", "<|endoftext|>", "<s>", "</s>", "'ll", " the", "   ", " cat", "\r\n", "\x00", "<0x41>"]


def odd_texts(seed=1, n=150):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x3000), rng.randrange(0xE000, 0x20000)])) for _ in range(20)) for _ in range(n // 3)]
    texts += ["x" + chr(i) + " b " + chr(i) + "  c" + chr(i) * 2 + " d" for i in (*range(1, 0x300), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF)]
    return [*texts, None, "", " ", "  ", "a", " a ", "the the the", "the the the", "<|endoftext|>", "a<|endoftext|> b", "ab" * 3000, " " * 3000, "word " * 2000, "é" * 1000, "don't we'll it's"]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def test_counts_are_those_of_the_library(spark):
    texts = odd_texts()
    lib = Tokenizer.from_file(BYTES)
    n = [len(e.ids) for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    want = [(i, i, len((t or "").encode()), k, k > 1024) for i, (t, k) in enumerate(zip(texts, n, strict=True))]
    df = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = token_counts.counted(df, BYTES)
    assert got.columns == ["doc_id", "N_A", "n_bytes", "n_tokens", "over_limit"]
    assert in_order(got.collect()) == in_order(want)
    assert in_order(token_counts.counted(df, BYTES, most=1).collect()) == in_order(want)
    assert token_counts.counted(df.limit(0), BYTES).count() == 0


def test_merging_in_step_is_merging_one_by_one():
    """A plain merger of random vocabularies: lowest rank first, leftmost first."""
    rng = random.Random(4)
    for seed in range(20):
        vocab = {letter: i for i, letter in enumerate(cross_tokens.byte_letters())}
        merges = []
        names = [*"ab"]
        for _ in range(30):
            pair = rng.choice(names), rng.choice(names)
            if "".join(pair) not in vocab:
                vocab["".join(pair)] = len(vocab)
                merges.append(pair)
                names.append("".join(pair))
        rank = {p: i for i, p in enumerate(merges)}

        def plain(word):
            s = list(word)
            while True:
                found = [(rank[p], i) for i, p in enumerate(zip(s, s[1:])) if p in rank]
                if not found:
                    return len(s)
                i = min(found)[1]
                s[i : i + 2] = [s[i] + s[i + 1]]

        words = ["".join(rng.choice("aab") for _ in range(rng.randint(1, 40))) for _ in range(60)] + ["c", "a" * 33, ""]
        assert token_counts.Merges(vocab, merges).counts(words).tolist() == [plain(w) if w else 0 for w in words], seed


def test_long_words():
    counter, lib = token_counts.Counter(BYTES), Tokenizer.from_file(BYTES)
    rng = random.Random(2)
    texts = ["a" * 100_000, "".join(rng.choice("etaoinshr") for _ in range(30_000)), "\n" * 50_000, "漢字" * 20_000]
    assert counter.counts(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def brute_alignment(texts):
    """Everything from byte offsets of whole texts' tokens."""
    lib, sp = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    lib.encode_special_tokens = True
    vocab = {i: p for p, i in lib.get_vocab().items()}
    letters = cross_tokens.byte_letters()
    out, links = [], []
    for t in texts:
        a = lib.encode(f" {t}", add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        xs = [bytes(letters[c] for c in vocab[i]) for i in a]
        ys = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or not (b"".join(xs) == b"".join(ys) == f" {t}".encode()):
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        spans = []
        for side in (xs, ys):
            at, found = 0, []
            for x in side:
                found.append((at, at + len(x)))
                at += len(x)
            spans.append(found)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, begin = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, found, strict=True) if begin <= s and e <= cut) for ids, found in zip((a, b), spans, strict=True)))
            begin = cut
        links.append([(i, j) for i, (s, e) in zip(a, spans[0], strict=True) for j, (u, v) in zip(b, spans[1], strict=True) if s < v and u < e] if len(a) < 3000 else [(a[i], b[j]) for i, j in sweep(*spans)])
        out.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for found in links for x in found)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(na, nb, ng, len(found), sum(count[x] == best[x[1]] for x in found), sum(count[x] for x in found), sha) for (na, nb, ng, sha), found in zip(out, links, strict=True)]


def sweep(xs, ys):
    i = j = 0
    while i < len(xs) and j < len(ys):
        yield i, j
        ei, ej = xs[i][1], ys[j][1]
        i, j = i + (ei <= ej), j + (ej <= ei)


@pytest.mark.parametrize("block_bytes", [1, 500, 1 << 22])
def test_alignment_is_that_of_byte_offsets(spark, block_bytes):
    texts = odd_texts(7, 90)
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(None, "the cat", None, None), (3, texts[3], None, None)]
    got = cross_tokens.aligned(spark.createDataFrame(rows, SCHEMA).repartition(3), BYTES, PIECES, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(r[0], *x) for r, x in zip(rows, brute_alignment([r[1] for r in rows]), strict=True)]
    assert in_order(got.collect()) == in_order(want)
    assert any(r[1] and not w[1] for r, w in zip(rows, want, strict=True)), "no text whose tokens don't spell it"


def test_alignment_of_nothing(spark):
    assert cross_tokens.aligned(spark.createDataFrame([], SCHEMA), BYTES, PIECES).count() == 0
    rows = cross_tokens.aligned(spark.createDataFrame([(1, None, "", 0), (2, "", "", 0)], SCHEMA), BYTES, PIECES).collect()
    assert in_order(rows) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_transducer_groups_and_links():
    t = cross_tokens.Transducer([b"ab", b"c", b"abc", b"de"], [b"a", b"bc", b"d", b"e", b"cde"])
    assert t.align([0, 1, 3], [0, 1, 2, 3]) == (["0,1|0,1", "3|2,3"], [0 << 32 | 0, 0 << 32 | 1, 1 << 32 | 1, 3 << 32 | 2, 3 << 32 | 3])
    assert t.seen[0, b"ab", 0] == (0, b"b") and t.seen[0, b"b", 1] == (1, b"c")
    with pytest.raises(ValueError):
        t.align([0], [2])
