"""Ranked search against brute force and SQL, and its bounds against exact scores."""

from __future__ import annotations

import math
import os
import random
import re
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import compare  # noqa: E402

from windrose.llm import lexical_search, queries  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, sketch string, row string, n int"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    counted = [(d, i, Counter(terms(t))) for i, (d, t) in enumerate(docs)]
    counted = [(d, i, c, sum(c.values())) for d, i, c in counted if c]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, i, c, n in counted:
            m = 75 + (25 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, i))
        out += [(item, r, None if none else d, -s) for r, (s, none, d, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    out = queries.op13_lexical_search(spark, sf_dir)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(docs, items)
    compare(out, queries.SEARCH_SQL, sf_dir)


def edge_docs():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "ÀB"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(120)]
    rows += [(200 + i, "same Text again, w1-w2!") for i in range(40)] + [(None, "same text again w1 w2"), (None, "lonely"), (5, "w1 w1 w1"), (5, "w1 w1 w1"), (6, None), (7, ""), (8, " ,.;\n"), (9, "solo\x00word\x7fend")]
    rows += [(300, " ".join(rng.choices(words, k=20_000)) + " needle")]
    return rows


ITEMS = [(1, "same text AGAIN"), (1, "w1 w1 W2"), (2, None), (3, "?!"), (None, "needle w3"), (4, "absent"), (5, "É naïve àb ÀB"), (6, "lonely solo word end"), (7, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("settings", [{}, {"HEAVY": 3, "FIRST": 2, "QUERY_BYTES": 30, "MEMO": 10}])
def test_edge_cases_and_small_settings(spark, settings, monkeypatch):
    for name, value in settings.items():
        monkeypatch.setattr(lexical_search, name, value)
    rows = edge_docs()
    docs = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], DOCS)
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, query int")
    for k in (20, 1):
        got = lexical_search.search(lexical_search.build(docs), items, k=k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, ITEMS, k)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert lexical_search.search(lexical_search.build(docs), items).isEmpty()
    assert lexical_search.search(lexical_search.build(docs.limit(0)), items).isEmpty()
    some = lexical_search.build(spark.createDataFrame([(1, "word")], "doc_id long, text string"))
    assert lexical_search.search(some, items.limit(0)).isEmpty()


def test_bounds_are_never_below_scores():
    import pyarrow as pa

    rows = [lexical_search.terms(t) for _, t in edge_docs() if lexical_search.terms(t)]
    df = Counter(t for r in rows for t in set(r))
    scale = lexical_search.Scale(len(rows), sum(map(len, rows)))
    weights = {t: lexical_search.weight(len(rows), n) for t, n in df.items()}
    sketcher = lexical_search.Sketcher(scale, {t: w for t, w in weights.items() if df[t] > 20})
    sketches = pa.array([sketcher(r) for r in rows], pa.binary())
    block = lexical_search.Queries([(i, dict(Counter(lexical_search.terms(t))), 1) for i, (_, t) in enumerate(ITEMS)], weights, scale)
    bounds = block.bounds(sketches)
    for q in range(len(ITEMS)):
        for d, own in enumerate(rows):
            assert bounds[q, d] >= block.score(q, Counter(own), scale.norm(len(own)))
