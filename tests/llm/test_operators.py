"""Each operator against brute force, on the smallest documents and on hand-made edge cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from windrose.llm import (  # noqa: E402
    automaton_dedup, bpe, decontamination, importance, jaccard_join, language_codes, line_dedup, pii, quality_outliers, queries, suffix_dedup,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string"


def edge_rows() -> list[tuple]:
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(400)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(4)]
    near = [" ".join(w if i != 60 + k else f"x{k}" for i, w in enumerate(base[0].split())) for k in range(6)]
    texts = [None, "", "  \n\t ", "one", "One TWO", *base, *near, base[1], base[1], "a " * 300, ("line %d of text\n" * 3 % (1, 2, 3)) * 4, base[2][:200] + " " + base[3], " ".join(rng.choices(words, k=20000))]
    return [(i, t, None if i % 5 == 0 else "en", "s", None, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    edges = spark.createDataFrame(edge_rows(), SCHEMA).withColumn("doc_id", F.col("doc_id") + 10_000)
    return plain.withColumn("block", F.lit("x")).unionByName(edges.select(*plain.columns, "block")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_suffix_dedup(docs, rows):
    out = suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == brute.op2(rows)


def test_automaton_dedup(docs, rows):
    out = automaton_dedup.automaton_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == brute.op4(rows)


@pytest.mark.parametrize("hot", [1, 48])
def test_hot_anchors_change_nothing(docs, rows, hot, monkeypatch):
    from windrose.llm import repeats

    monkeypatch.setattr(repeats, "HOT_BLOCKS", hot)
    out = suffix_dedup.suffix_dedup(docs).select("doc_id", "n_removed")
    assert {r[0]: r[1] for r in out.collect()} == {k: v[1] for k, v in brute.op2(rows).items()}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_join(docs, rows, n, percent):
    out = jaccard_join.jaccard_join(docs, n=n, percent=percent)
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == brute.op10(rows, n, percent)


def test_line_dedup(docs, rows):
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines_removed"]
    got = {r[0]: tuple(r[1:]) for r in out.select("doc_id", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()}
    assert got == brute.op3(rows)


def test_quality_statistics(docs, rows):
    out = quality_outliers.quality_outliers(docs)
    got = {r[0]: tuple(r[1:]) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == brute.op6(rows)
    assert out.where("base_failed and kept").isEmpty()


def test_bpe_equals_library(docs, rows):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    out = bpe.decode(bpe.encode(docs, path, P.PATTERN), path).select("doc_id", "ids", "decoded").collect()
    text = dict(rows)
    assert all(r.ids == library.encode_ordinary(text[r.doc_id] or "") and bytes(r.decoded) == (text[r.doc_id] or "").encode() for r in out)


def test_surrogates(spark):
    texts = ["mail ann.b@mail.example.com or ann.b@mail.example.com", "card 4929348385146306, (017) 555-7713", "Mrs. Anna Smith of 10.0.0.1\u0001end", None, "clean 12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in pii.surrogates(docs, "k").orderBy("doc_id").collect()]
    first = out[0].split()
    assert first[1] == first[3] != "ann.b@mail.example.com" and first[1].endswith(".com")
    card = out[1].split()[1].strip(",")
    assert len(card) == 16 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    assert out[2].startswith("Mrs. ") and "Anna" not in out[2] and out[2].endswith("\u0001end")
    assert out[3:] == [None, "clean 12"]


def test_decontamination(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly boxed"
    docs = spark.createDataFrame([(1, "start " + item + " end"), (2, "start " + item.replace("lazy", "hazy").upper()), (3, "nothing here"), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontamination.decontamination(docs, bench).collect()}
    assert got == {(1, 7, 0), (2, 7, 1)}
    assert decontamination.decontamination(docs, bench.limit(0)).isEmpty()


def test_short_items_may_differ_as_well(spark):
    item = "seven wizards quietly boxed in a ring."  # 38 characters: three edits
    texts = [item, item.replace("boxed", "foxed"), item.replace("quiet", "riot"), "eight lizards calmly boxed on a string", "bad gap", "tin lid"]
    docs = spark.createDataFrame([*enumerate(texts), (None, item), (1, texts[1])], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "bad lid")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontamination.decontamination(docs, bench).collect()), key=repr)
    assert got == sorted([(0, 7, 0), (1, 7, 1), (1, 7, 1), (2, 7, 3), (None, 7, 0)], key=repr)


def distance(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = _next(row, i, a, text)
    return min(row)


def _next(row: list[int], i: int, a: str, text: str) -> list[int]:
    out = [i]
    for j, b in enumerate(text, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (a != b)))
    return out


def test_myers_distance():
    rng = random.Random(3)
    for _ in range(60):
        item = "".join(rng.choices("abc ", k=50))
        text = "".join(rng.choices("abc ", k=10)) + "".join(c for c in item if rng.random() > 0.05) + "b"
        want = distance(item, text)
        got = decontamination.Item(1, item, 0.1).nearest(text)
        assert got == (want if want <= 5 else None)


def test_importance_keeps_the_share(docs):
    good = docs.where("doc_id % 3 = 0").select("doc_id")
    out = importance.importance(docs, good, share=0.5)
    n, kept = out.count(), out.where("kept").count()
    assert kept >= (n + 1) // 2 and out.where("kept").agg(F.min("gumbel_key")).first()[0] >= out.where("not kept").agg(F.max("gumbel_key")).first()[0]
    assert importance.importance(docs.limit(0), good).isEmpty()


def test_languages_held_out(spark, sf_dir, docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = queries.op9_language_codes(spark, sf_dir).where("held_out").collect()
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.95 * len(out)
    odd = spark.createDataFrame([(1, None), (2, "12 34"), (3, "word")], "doc_id long, text string")
    empty = language_codes.fit(docs.limit(0))
    assert [r.lang_pred for r in language_codes.predict(odd, empty).collect()] == ["und"] * 3


@pytest.mark.parametrize("f", [suffix_dedup.suffix_dedup, automaton_dedup.automaton_dedup, jaccard_join.jaccard_join, line_dedup.line_dedup, quality_outliers.quality_outliers, lambda d: pii.surrogates(d, "k")])
def test_empty_table(docs, f):
    assert f(docs.limit(0)).isEmpty()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() < docs.count() and out.where("not round_trip").isEmpty()
    assert corpus_pipeline.quality(spark, docs, sf_dir).columns == docs.columns


def test_parities_never_differ_more_than_sets():
    draw = np.random.default_rng(5)
    sizes = jaccard_join.Sizes(80, 4000)
    for size in (1, 40, 130, 900):
        for shared in {0, size // 2, size}:
            common, left, right = (draw.integers(0, 2**63, k, dtype=np.uint64) for k in (shared, size - shared, 2 * size))
            a, b = (np.unique(np.concatenate([common, own])) for own in (left, right[: size - shared + size // 3]))
            least = np.bitwise_count((sizes.parity(a, 3) ^ sizes.parity(b, 3)).view(np.uint64)).sum()
            assert least <= len(np.setxor1d(a, b))
    assert not (sizes.parity(a, 3) ^ sizes.parity(a, 3)).any()


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key(percent):
    """Also sets so small that they agree in nothing but empty fragments."""
    draw = np.random.default_rng(7)
    for size in [*range(4, 40), 300]:
        for _ in range(60):
            a = np.unique(draw.integers(0, 2**64, size, dtype=np.uint64))
            gone = draw.integers(0, size * (100 - percent) // 100 + 1)
            b = np.unique(np.concatenate([a[gone:], draw.integers(0, 2**64, draw.integers(0, 2 + size // 8), dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if len(a) == len(b) == shared or 100 * shared < percent * (len(a) + len(b) - shared):
                continue
            sizes = jaccard_join.Sizes(percent, 400)
            keys = [{x for _, cut in sizes.cuts(s) for x in np.concatenate([cut.names, cut.spare]).tolist()} for s in (a, b)]
            assert keys[0] & keys[1]


def test_jaccard_rows_that_share_or_lack_an_id(spark):
    words = [f"w{i}" for i in range(80)]
    x, y = " ".join(words[:40]), " ".join(words[40:])
    rows = [(3, x), (7, x + " end"), (7, y), (1, y + " end"), (None, x), (None, None), (9, ""), (9, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.jaccard_join(docs, n=3, percent=90).collect())
    assert got == sorted([(3, 38, 1), (7, 39, 1), (7, 38, 1), (1, 39, 1), (-1, 38, -1), (-1, 0, -1), (9, 0, 9), (9, 1, 9)])


def test_rows_that_share_or_lack_an_id_keep_their_own_lines(spark):
    rows = [(1, "a\nb\nc"), (None, "a\nb\nc\nq"), (None, "u1\nu2\nu3\nu4"), (5, "a\nb\nc"), (5, "x\ny\nz\nw")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.line_dedup(docs).collect())
    assert got == [(0, "q"), (0, "u1\nu2\nu3\nu4"), (1, "a\nb\nc"), (5, ""), (5, "x\ny\nz\nw")]


@pytest.mark.parametrize("f,column", [(suffix_dedup.suffix_dedup, "n_removed"), (automaton_dedup.automaton_dedup, "n_removed")])
def test_substrings_with_repeated_and_null_ids(spark, f, column):
    base, other = (" ".join(f"{x}{i}word" for i in range(60)) for x in "ab")
    rows = [(2, base), (2, other), (None, base), (None, other), (None, None), (7, base + " " + other), (1, "short")]
    out = f(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = sorted((r.doc_id or 0, r[column]) for r in out)
    n = [len(base), len(other)] if f is suffix_dedup.suffix_dedup else [60, 60]
    assert gone == sorted([(2, 0), (2, 0), (0, n[0]), (0, n[1]), (0, 0), (7, n[0] + n[1]), (1, 0)])


def test_codewords_stand_apart():
    for n in (2, 3, 5, *range(6, 20), 60, 300):
        code = language_codes.codewords(n)
        columns = {min(c.tobytes(), (1 - c).tobytes()) for c in code.T}
        assert len(columns) == code.shape[1] and all(0 < c.sum() < n for c in code.T) and len({r.tobytes() for r in code}) == n


def test_eight_languages(spark):
    draw, rows = random.Random(2), []
    letters = ["abcdefg", "hijklmn", "opqrstu", "vwxyzab", "acegikm", "bdfhjln", "оеаинтс", "αεηικλμ"]
    for k, own in enumerate(letters):
        rows += [(100 * k + i, " ".join("".join(draw.choices(own, k=draw.randint(2, 8))) for _ in range(30)), f"l{k}") for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string")
    model = language_codes.fit(docs.where("doc_id % 2 = 0"))
    out = language_codes.predict(docs, model).collect()
    assert len(out) == len(rows) + 5 and all(r.lang_pred == f"l{r.doc_id // 100}" for r in out)
    one = language_codes.fit(docs.where("lang = 'l3'"))
    assert {r.lang_pred for r in language_codes.predict(docs, one).collect()} == {"l3"}
    assert language_codes.predict(docs.limit(0), model).isEmpty()


def test_control_marks_come_back(spark):
    text = "a\u0001\u0002\u0001b\u0002 x@y.example.com \u0001"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = pii.surrogates(docs, "k").first().text
    assert out.startswith("a\u0001\u0002\u0001b\u0002 ") and out.endswith(" \u0001") and "x@y" not in out


def test_decoding_trees(spark):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    tokens = {rank: token for token, rank in bpe.read_ranks(path).items()}
    rows = [(i, ids) for i, ids in enumerate([None, [], [5], list(range(64)), list(range(300, 429)), [7] * 1000, [], None])]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1)
    got = {r.doc_id: r.decoded for r in bpe.decode(docs, path).collect()}
    assert got == {i: None if ids is None else bytearray(b"".join(tokens[x] for x in ids)) for i, ids in rows}
    with pytest.raises(Exception):
        bpe.decode(spark.createDataFrame([(1, [10_000_000])], "doc_id long, ids array<int>"), path).collect()


def test_decontamination_equals_brute_force(spark):
    """All items against all texts: edits at any place, items at either end of a text, long texts, repeated items, clashing columns."""
    draw = random.Random(9)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti", "vo")]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(4, 24)))) for i in range(8)]
    items += [(20, items[3][1]), (21, "short one"), (22, None)]

    def spoiled(text: str, n: int) -> str:
        for _ in range(n):
            at = draw.randrange(len(text))
            text = draw.choice([text[:at] + text[at + 1 :], text[:at] + "z" + text[at:], text[:at] + "Q" + text[at + 1 :]])
        return text

    texts = [None, "", " ".join(draw.choices(words, k=4000))]
    for _, item in items[:8]:
        for n in (0, 1, 3, 5, 9):
            before, after = (" ".join(draw.choices(words, k=draw.choice([0, 0, 40]))) for _ in range(2))
            texts.append(f"{before} {spoiled(item, n)} {after}".strip().upper())
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in enumerate(texts)], "doc_id long, text string, item_id int, distance int")
    found = decontamination.decontamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = set()
    for i, text in enumerate(texts):
        for k, item in items:
            if text and item:
                a, b = decontamination.plain(item), decontamination.plain(text)
                d = distance(a, b)
                if d <= int(len(a) * decontamination.RATE):
                    want.add((i, k, d))
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == want and len(found) == len(want)


def test_importance_weights_equal_a_plain_version(spark):
    texts = ["a b c a", "b c", None, "", "good words here good words", "good words", "a b c a", "x" * 5000]
    docs = spark.createDataFrame([(i if i != 6 else None, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, log_weight double")
    good = spark.createDataFrame([(4,), (5,), (None,)], "doc_id long")
    import pyarrow as pa

    grams = [importance.buckets_of(pa.array([t], pa.string()))[0].astype(int) for t in texts]
    raw, target = (np.bincount(np.concatenate(x), minlength=importance.BUCKETS) for x in (grams, [grams[4], grams[5]]))
    ratio = np.log((target + 1) / (target.sum() + importance.BUCKETS)) - np.log((raw + 1) / (raw.sum() + importance.BUCKETS))
    out = importance.importance(docs, good, share=0.5).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, round(r.log_weight, 6)) for r in out)
    assert got == sorted((-1 if i == 6 else i, round(float(ratio[g].sum()), 6) + 0.0) for i, g in enumerate(grams))
    order = sorted(out, key=lambda r: -r.gumbel_key)
    assert [r.kept for r in order] == [r.gumbel_key >= order[3].gumbel_key for r in order]
    assert len(grams[0]) == 7 and len(grams[2]) == 0


def test_idle_workers_let_go_of_what_they_remember(monkeypatch):
    """After a while without a batch both caches are empty; the next batch gives the same ids."""
    import time

    import public_tokenizers
    import pyarrow as pa

    class Ranks:
        value = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))

    monkeypatch.setattr(bpe, "IDLE", 0.2)
    texts = pa.array(["so many words, so little time", None, ""])
    first = bpe._ids_of(texts, Ranks, "x", public_tokenizers.PATTERN)
    assert bpe._bytes_of(first, Ranks, "x").to_pylist() == [b"so many words, so little time", b"", b""] and bpe._ENCODERS and bpe._DECODERS
    time.sleep(1.0)
    assert not bpe._ENCODERS and not bpe._DECODERS and bpe._KEPT.watch is None
    assert bpe._ids_of(texts, Ranks, "x", public_tokenizers.PATTERN).equals(first)
