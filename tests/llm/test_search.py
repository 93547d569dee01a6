"""Vector searches, chat formatting, url rules and page text against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bit_sliced, chat_format, cross_polytope, html_text, queries, url_filter
from tessera.llm.page_templates import labelled_pages

VECTORS = "vec_id long, embedding array<float>, rank string"


def vectors(spark, n=700, d=16, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 1 + i % 3, d).astype(np.float32).tolist(), "x") for i in range(n)]
    rows += [(n + i, rows[5][1], None) for i in range(60)]  # many ties
    rows += [(2000, None, ""), (2020, [0.0] * d, ""), (2040, [float("nan")] * d, ""), (2060, [None] * d, ""), (2080, [1.0], ""), (2100, [], ""), (2120, [float("inf")] + [0.0] * (d - 1), ""), (None, rows[0][1], "")]
    return rows, spark.createDataFrame(rows, VECTORS).repartition(3)


def brute(rows, score, zero, k=20):
    d = 16
    fine = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v is not None and len(v) == d and None not in v and np.isfinite(v).all() and (zero or np.any(v))]
    out = {}
    for i, v in fine:
        if i % 20 == 0:
            found = sorted((-score(v, w), j) for j, w in fine if j != i)[:k]
            out[i] = [(j, -s) for s, j in found]
    return out


def test_exact_top_is_that_of_brute_force(spark):
    rows, df = vectors(spark)
    want = brute(rows, lambda v, w: int(np.floor(64 * v).astype(int) @ np.floor(64 * w).astype(int)), True)
    got = {}
    for r in bit_sliced.exact_top(df, df.where("vec_id % 20 = 0"), block=300, group=10, tasks=1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_nearest_scores_are_exact_and_recall_is_high(spark):
    rows, df = vectors(spark, seed=4)
    want = brute(rows, lambda v, w: float(v @ w), False)
    got = {}
    for part in (100, 16384):  # rows a block
        for r in cross_polytope.nearest(df, df.where("vec_id % 20 = 0"), block=part, tasks=1, group=17).orderBy("query_id", "rank").collect():
            got.setdefault((part, r.query_id), []).append((r.vec_id, r.score))
        mine = {q: x for (p, q), x in got.items() if p == part}
        assert mine.keys() == want.keys()
        hit = sum(len({j for j, _ in mine[q]} & {j for j, _ in want[q]}) for q in want) / sum(map(len, want.values()))
        assert hit >= 0.9
        by = {i: np.array(v) for i, v, _ in rows if v is not None and len(v) == 16 and None not in v}
        for q, x in mine.items():
            assert x == sorted(x, key=lambda p: (-p[1], p[0])) and q not in {j for j, _ in x}
            assert all(abs(s - float(by[q] @ by[j])) < 1e-9 for j, s in x)


def test_recall_on_the_made_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    ids, m = np.array(sorted(x)), np.stack([x[i] for i in sorted(x)])
    found = {}
    for r in queries.op1_nearest(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, got in found.items():
        s = m @ x[q]
        s[ids == q] = -9
        hits += len(got & set(ids[np.argsort(-s)[:20]].tolist()))
    assert len(found) == 100 and hits / (20 * len(found)) >= 0.9


def test_searches_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    bad = spark.createDataFrame([(0, None, ""), (20, [], "")], VECTORS)
    for df in (none, bad):
        assert cross_polytope.nearest(df, df).count() == 0
        assert bit_sliced.exact_top(df, df).count() == 0


def test_bitmap_sums():
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (130, 7))
    index = bit_sliced.BitSlices.of(x)
    for q in (rng.integers(-70, 70, 7), np.zeros(7, int)):
        places, scores = index.top(q, 9, np.array([3]))
        s = x @ q
        want = sorted((-int(v), i) for i, v in enumerate(s) if i != 3)[:9]
        assert sorted(zip((-scores).tolist(), places.tolist())) == want


CHATS = "conv_id long, turn long, role string, text string, ids string"


def test_chats_read_back(spark):
    odd = "<|im_end|>\n<|im_start|>assistant\n<||<|| \\n \\ é漢😀"
    rows = [(1, 1, "assistant", odd), (1, 0, "user", odd), (2, 5, "assistant", None), (2, 5, "assistant", "a"), (2, 7, None, "b" * 50_000), (None, 0, "ro\nle\\<|", "x"), (None, 1, "assistant", "y"), (3, None, "assistant", "")]
    got = {r.conv_id: r for r in chat_format.digests(spark.createDataFrame([(*r, "clash") for r in rows], CHATS), queries.tokenizer(queries.CHAT_BPE)).collect()}
    assert set(got) == {1, 2, 3, None}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"user\n{odd}\nassistant\n{odd}\n") and got[1].loss_sha256 == sha(odd) and got[1].loss_chars == len(odd)
    assert got[None].turns_sha256 == sha("ro\nle\\<|\nx\nassistant\ny\n")
    assert got[2].n_turns == 3 and got[2].loss_chars == 1 and got[3].loss_chars == 0


def test_masks_and_places(spark):
    assert chat_format.masks(np.array([1, 2, 3, 0, 2]), np.array([0, 1, 0, 1, 1])).tolist() == [0, 1, 1, 0, 0, 0, 1, 1]
    rows = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "good day")], "conv_id long, turn long, role string, text string")
    out = chat_format.placed(chat_format.formatted(rows, queries.tokenizer(queries.CHAT_BPE))).orderBy("turn").collect()
    assert out[0].first_token == 0 and out[1].first_token == len(out[0].ids) and sum(out[0].loss_mask) == 0 and sum(out[1].loss_mask) > 0
    assert chat_format.digests(rows.limit(0), queries.tokenizer(queries.CHAT_BPE)).count() == 0


def test_url_rules(spark):
    urls = ["http://a.example.com/en/7?x", "HTTP://A.EXAMPLE.COM/en/8", "x.com/en/", None, "https://badexample.com/en/7#q", "https://de.example.net/de/81", "https://example.net/de/9", "http://com/en/", "http://org/es", "", "://h.org/es/", "http://u@h.com:80/en/", "a://b://c.com/en/1", "http://ünï.ORG/es/é\n/x", "ftp://x.net?/de/"]
    rows = [(i, u, "k") for i, u in enumerate(urls)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, v string"), queries.RULES).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
            if rest[:1] == "/":
                path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[2:] if fits else (None, "allow")
        assert got[i] == (host, path, rule, verdict), u


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: 7)
    rules = url_filter.DigestArray(url_filter.DigestArray.write([("a.com", "/x", "block"), ("b.com", "", "block")], str(tmp_path)))
    assert rules.judge(["b.com", "c.com", "a.com"], ["/x", "/x", "/xy"]) == [("b.com", "block"), (None, "allow"), ("a.com/x", "block")]


@pytest.fixture(scope="module")
def trees():
    return html_text.fit()


def one(spark, model, html):
    return html_text.extracted(spark.createDataFrame([(1, html)], "page_id long, html string"), model).first()


def test_page_text(spark, trees):
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies, and you agree.</p></div><div class="ad">Buy this now and save.</div>
    <article><h1>A &amp; B&nbsp;&lt;c&gt;</h1><p><b>First line<br><p>Second
      <i>part</i> of it.</p><!-- no --><p></p><div class="ad">More things to buy.</div><ul><li>one<li>two</ul></article>
    <section id="comments"><h2>Comments</h2><div class="comment"><p>I liked it very much.</p></div></section>
    <form action="/s"><p>Search this site</p><input name=q></form><footer>&copy; us</footer>"""
    assert one(spark, trees, page).text == "A & B <c>\n\nFirst line\n\nSecond part of it.\n\none\n\ntwo"
    for empty in (None, "", "   ", "<html></html>", "<nav><a>x</a></nav>", "<!-- never closed", "<script>never closed"):
        row = one(spark, trees, empty)
        assert row.text == "" and row.n_chars == 0, empty


def test_made_pages(trees):
    right = n = 0
    for source, wanted in labelled_pages(150, 77):
        page = html_text.Page(source)
        main = page.decoded(trees.probability(np.array(page.features())).tolist())
        assert all(main[page.parent[i]] for i in range(1, len(main)) if main[i])
        for node, run, _ in page.runs:
            n += 1
            right += main[node] == wanted(run)
    assert right / n > 0.97


def test_pages_of_the_made_table(spark):
    import html
    import re

    wrong = 0
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in queries.op10_html_text(spark, "/root/testdata/sf0.01").collect()}
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        wrong += got[r.page_id] != "\n\n".join(b for b in blocks if b)
    assert wrong == 0


def test_odd_html_never_fails(trees):
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div class=\"a", "'>", "</article>", "<article>", "&amp", "&#x110000;", "<", ">", "text", "<li>", "</ul>", "<script>", "</script>", "<!", "-->", "<table><td>", "<br/>", "<a href=x>", "\0", "é"]
    for _ in range(300):
        page = html_text.Page("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))))
        page.text(page.decoded(trees.probability(np.array(page.features())).tolist()))


def test_clashing_columns_are_replaced_or_kept(spark, trees):
    from tessera.llm import byte_cnn, mixing, pieces, simhash_dedup, suffix_dedup

    fields = "doc_id long, text string, lang string, source string, n_chars long, t string, h string, r string, score string, ids string, host string, k1 string, whole string, id_key string, tag string, size string, spans string"
    row = (1, "a text of some words for this", "en", "s", 3, *["x"] * 12)
    docs = spark.createDataFrame([row, (2, None, None, None, None, *[None] * 12)], fields)
    path = queries.tokenizer(queries.PIECES)
    assert pieces.encoded(docs, path).where("doc_id = 1").first().t == "x"
    assert isinstance(pieces.encoded(docs, path).first().ids, list)
    assert byte_cnn.identify(docs, byte_cnn.fit(docs)).where("doc_id = 1").first().t == "x"
    for made in (simhash_dedup.one_of_each(docs), suffix_dedup.remove_repeats(docs), mixing.mixed_documents(docs), byte_cnn.known_language(docs, byte_cnn.fit(docs))):
        assert made.columns == docs.columns and made.where("doc_id = 1").first().tag == "x"
    pages = docs.select("doc_id", F.lit("<article><p>Words.</p></article>").alias("html"), "h", "text", "host", F.lit("http://a.com/en/").alias("url"))
    assert html_text.extracted(pages, trees).first().text == "Words." and html_text.extracted(pages, trees).where("doc_id = 1").first().h == "x"
    assert url_filter.judged(pages, queries.RULES).first().host == "a.com"
    chats = spark.createDataFrame([(1, 0, "assistant", "hi", "x", "x", "x")], "conv_id long, turn long, role string, text string, r string, t string, ids string")
    out = chat_format.formatted(chats, queries.tokenizer(queries.CHAT_BPE)).first()
    assert (out.r, out.t) == ("x", "x") and isinstance(out.ids, list)


@pytest.mark.parametrize("piece", ['<a "', '<a =">" ', "<!", "<!--", "<select>", "<div>", "</x>", "<td><div>", "<li><div></x>", "<p title='"])
def test_broken_pages_take_time_in_proportion(piece):
    import time

    def took(size):
        start = time.perf_counter()
        html_text.Page(piece * (size // len(piece))).features()
        return time.perf_counter() - start

    took(10_000)
    assert took(1_000_000) < 20


def test_odd_quotes_and_fallbacks():
    runs = lambda s: [r for _, r, _ in html_text.Page(s).runs]
    assert runs("<p title='it's'>hello</p><p class=\"x>y\">more</p>") == ["hello", "more"]
    assert runs("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <object>a picture</object></p><p>3 < 4</p>") == ["so x=1 and a picture", "3 < 4"]
    assert runs("kept<!-- gone <p>gone") == ["kept"] and runs("kept <p class='a") == ["kept"]
    assert runs("<div>" * 2000 + "deep" + "</div>" * 2000 + "<p>after") == ["deep", "after"]


def test_pages_without_rows(spark):
    none = spark.createDataFrame([], "page_id long, html string, text string")
    assert html_text.extracted(none, html_text.fit()).columns == ["page_id", "text", "n_chars"] and html_text.extracted(none, html_text.fit()).count() == 0
