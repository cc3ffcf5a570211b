"""Prefix token counts against the library's own encoding of every prefix."""

from __future__ import annotations

import random
import unicodedata

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from windrose.llm import queries, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as lines:
        return token_counts.PrefixCounter(lines.read())


def brute(library, text):
    return [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


CASES = [
    "", " \n\t ", "Hello wörld's 123 <|endoftext|> x", "don't we'll they're i'm o'neil 'rex 're '' ''s '", "abc<|startoftext|><|endoftext|>x<|endo", "日本語テキスト😀 かき",
    "İstanbul ΣΑΣ Σ. straße", "éậ 'é 'ŕe 'ré", unicodedata.normalize("NFD", "ệ Ünïcödé 한국어 텍스트 がぎぐげご"), "a​b c　d\u0085e f\x1cg", "x" * 200 + "!" * 100 + "9" * 20,
    unicodedata.normalize("NFD", "が" * 60 + "éà" * 40 + "'s"), "각ᆨ ୋ ো", "ﬁ Å ½ ² ̈́ ̀", "á<|endoftext|>́b",
]


@pytest.mark.parametrize("text", CASES)
def test_every_prefix_of_odd_texts(library, counter, text):
    assert counter(text).tolist() == brute(library, text)


@pytest.mark.parametrize("letters", ["abcdeé'ſKİσΣ <|>゙̣́か각 1½\n!?rtsvlmd", "abcé's <|>1\n!?rtsvlmd", "ab'rest  \t"])
def test_every_prefix_of_random_texts(library, counter, letters):
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choices(letters, k=rng.randrange(1, 40)))
        assert counter(text).tolist() == brute(library, text), text


def test_small_memories_change_nothing(library, counter, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 2)
    text = "many different words in one text, many of them twice in this text"
    assert counter(text).tolist() == brute(library, text)


def test_query_and_prefixes_of_documents(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op12_token_counts(spark, sf_dir).collect()}
    n = {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    assert got == {d: (len(t.encode()), n[d], n[d] > 2048) for d, t in texts.items()}


def test_questions_nulls_repeats_and_clashing_names(spark, library, monkeypatch):
    monkeypatch.setattr(token_counts, "SLICE", 8)
    texts = [None, "", "the unbelievable cat", "the unbelievable cat", "zq xj zqxj"]
    df = spark.createDataFrame([(1, t, "old", [1]) for t in texts], "doc_id long, text string, counts string, batch array<int>")
    out = token_counts.prefix_counts(df, PATH)
    assert out.columns == ["doc_id", "text", "batch", "counts"] and token_counts.prefix_counts(df.limit(0), PATH).isEmpty()
    rows = out.select("text", "counts", token_counts.total().alias("all"), token_counts.count_at(6).alias("six"), token_counts.count_at(999).alias("far"), *[token_counts.longest_within(b).alias(f"b{b}") for b in (0, 2)], token_counts.truncated(2).alias("cut")).collect()
    assert sorted((r.text or "") for r in rows) == sorted(t or "" for t in texts)
    for r in rows:
        want = brute(library, r.text or "")
        assert r.counts == want and r["all"] == r.far == want[-1] and r.six == want[min(6, len(want) - 1)]
        for b in (0, 2):
            assert r[f"b{b}"] == max(i for i, n in enumerate(want) if n <= b)
        assert r.text is None or r.cut == r.text[: r.b2]


def test_long_text_and_word(spark, library):
    text = "word and more words, " * 20_000 + "k" * 30_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = token_counts.prefix_counts(df, PATH).select(token_counts.total().alias("n"), F.size("counts").alias("size")).first()
    assert tuple(got) == (len(library.encode(text, add_special_tokens=False).ids), len(text) + 1)
