"""Very long hosts and white space, odd letters, map columns, many labels."""

import public_tokenizers
import pytest

from tessera.llm import byte_cnn, chat_format, simhash_dedup, url_filter
from tessera.llm.queries import RULES


def test_very_long_hosts(tmp_path):
    rules = url_filter.DigestArray(url_filter.DigestArray.write(RULES, str(tmp_path)))
    hosts = ["a." * 200_000 + "example.com", "a." * 1000 + "com", "x" * 50_000 + "example.com", "example.com", "", "com", ".net", "é.example.net", "aexample.net"]
    got = rules.judge(hosts, ["/en/7"] * 6 + ["/de/8"] * 3)
    assert got == [("example.com/en/7", "allow"), ("com/en/", "block"), ("com/en/", "block"), ("example.com/en/7", "allow"), (None, "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow")]


@pytest.mark.parametrize("text", ["a" + " " * 20_000 + "b", " " * 20_000, "x" + "\n " * 9000 + "\n", "\t" * 15_000 + " y" + " " * 10_001 + "\n", "é" + "\u3000" * 12_000 + "e"])
def test_long_white_space_has_the_ids_of_the_library(text):
    code = chat_format.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert code.encode(text) == code.bpe.encode_ordinary(text)


def test_very_long_white_space(spark):
    rows = [(1, 0, "user", " " * 1_600_000), (1, 1, "assistant", "a" + "\n " * 800_000 + "b"), (2, 0, "assistant", None)]
    got = {r.conv_id: r for r in chat_format.digests(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 1_600_002 and got[2].loss_chars == 0


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ² ①", "Ⅷ", "12 !", "", None, "ª", "漢"])], "doc_id long, text string")
    model = byte_cnn.ByteCNN.train([b"der die das", b"the of and"], ["de", "en"], epochs=1)
    got = {r.doc_id: r.lang_pred for r in byte_cnn.identify(docs, model).collect()}
    assert [got[i] == "und" for i in range(7)] == [True] * 5 + [False] * 2


def test_many_labels_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}", f"label{i % 300}") for i in range(1500)], "doc_id long, text string, lang string")
    model = byte_cnn.fit(docs, most=100, epochs=1)
    assert model is not None and 20 < len(model.classes) <= 240


def test_map_columns_stay(spark):
    rows = [(1, "one two three four five six", {"b": 1, "a": 2}), (1, "one two three four five six", {"a": 1}), (2, "one two three four five six", None), (3, "other words", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string, int>")
    got = simhash_dedup.one_of_each(docs, words=5, similarity=(4, 5)).collect()
    assert sorted(r.doc_id for r in got) == [1, 3] and next(r for r in got if r.doc_id == 3).tags == {}
