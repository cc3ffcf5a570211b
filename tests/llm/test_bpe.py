"""The encoder against the library on odd texts; what a worker holds, and how often rows go through Python."""

import random
import tracemalloc

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from windrose.llm import bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")


class Ranks:
    value = bpe.read_ranks(PATH)


LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=Ranks.value, special_tokens={})


def odd_texts() -> list[str | None]:
    some = random.Random(7)
    tokens = list(Ranks.value)
    out = [None, "", " ", "\0", "=" * 3000, "-=-" * 700, " " * 501 + "x", "\n" * 99, "ab" * 2000, "😀" * 60, "𝒳é" * 70, "9" * 400, "\u0085 "]
    out += [b"".join(some.choices(tokens, k=k)).decode("utf-8", "ignore") for k in (1, 2, 3, 8, 40) for _ in range(30)]
    out += ["".join(some.choices(letters, k=k)) for letters in ("ab", "enthes", "aé", "=-", " \n") for k in (6, 7, 13, 30, 65, 500) for _ in range(5)]
    return out


@pytest.mark.parametrize("slice_,cells,wide,leaf", [(1 << 22, 1 << 20, 64, 6), (500, 64, 64, 6), (1, 1 << 20, 8, 6), (1 << 22, 1 << 20, 64, 1)])
def test_odd_texts_equal_the_library(monkeypatch, slice_, cells, wide, leaf):
    """Whatever the bounds of slices, matrices and leaves are."""
    for name, value in (("SLICE", slice_), ("CELLS", cells), ("WIDE", wide), ("LEAF", leaf)):
        monkeypatch.setattr(bpe, name, value)
    texts = odd_texts()
    ids = bpe._ids_of(pa.array(texts, pa.string()), Ranks, "odd", P.PATTERN)
    assert ids.to_pylist() == [LIBRARY.encode_ordinary(t or "") for t in texts]
    assert bpe._bytes_of(ids, Ranks, "odd").to_pylist() == [(t or "").encode() for t in texts]
    assert bpe._ids_of(pa.array([], pa.string()), Ranks, "odd", P.PATTERN).to_pylist() == []


def test_a_worker_holds_no_more_after_more_pieces():
    some = random.Random(3)
    words = pa.array([" ".join("".join(some.choices("enthersia", k=9)) for _ in range(2000)) for _ in range(10)])
    bpe._ids_of(words[:1], Ranks, "held", P.PATTERN)
    tracemalloc.start()
    try:
        bpe._ids_of(words, Ranks, "held", P.PATTERN)
        assert tracemalloc.get_traced_memory()[0] < 500_000
    finally:
        tracemalloc.stop()


def test_rows_go_through_python_once(spark, sf_dir):
    plan = queries.op7_bpe(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("EvalPython") == 1


def test_round_trip_keeps_other_columns(spark, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 10)
    rows = [(i, t, [0], "x") for i, t in enumerate(["so many words", None, "", "so many words", "é" * 30])]
    docs = spark.createDataFrame(rows, "doc_id long, Text string, ids array<int>, kind string").coalesce(1)
    out = bpe.round_trip(docs, PATH, P.PATTERN)
    assert out.columns == ["doc_id", "Text", "kind", "ids", "decoded"]
    want = [(i, t, "x", LIBRARY.encode_ordinary(t or ""), bytearray((t or "").encode())) for i, t, *_ in rows]
    assert sorted(map(tuple, out.collect())) == want
    two_steps = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH).select(out.columns)
    assert sorted(map(tuple, two_steps.collect())) == want


def test_a_byte_that_the_vocabulary_lacks_raises():
    class Few:
        value = {b"a": 0, b"b": 1, b"ab": 2}

    assert bpe._ids_of(pa.array(["abab b", "ab"][1:]), Few, "few", P.PATTERN).to_pylist() == [[2]]
    with pytest.raises(ValueError):
        bpe._ids_of(pa.array(["abc"]), Few, "few", P.PATTERN)
