"""The fitted part of the quality operator against brute force, with groups on both sides of the least size."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from windrose.llm import quality_outliers as q


def rank(values, share: float) -> float:
    return np.expm1(np.quantile(np.round(np.log1p(values), 3), share))


def fitted(x: np.ndarray):
    """(mean, covariance, median distance) of the least determinant by concentration steps from three starts."""
    floor = np.array(q.FLOOR)
    far = lambda mean, cov: np.einsum("ij,ij->i", x - mean, np.linalg.solve(cov, (x - mean).T).T)
    of = lambda inner: (inner.mean(axis=0), np.cov(inner.T, bias=True) + np.diag(floor**2))
    nearest = lambda now, share: of(x[far(*now) <= rank(far(*now), share)])
    mean = np.array([rank(c, 0.5) for c in x.T])
    first = mean, np.diag(np.maximum(1.4826 * np.array([rank(c, 0.5) for c in abs(x - mean).T]), floor) ** 2)
    ends = []
    for now in (first, of(x), nearest(first, 0.5)):
        for _ in range(q.STEPS):
            now = nearest(now, q.SUBSET)
        ends.append(now)
    mean, cov = min(ends, key=lambda e: round(0.5 * np.log(np.linalg.det(e[1])), 9))
    return mean, cov, rank(far(mean, cov), 0.5)


def brute(rows: list) -> dict:
    """(kept, distance) by doc_id."""
    def vector(r):
        words, chars = max(r.n_words, 1), max(r.word_chars, 1)
        return [math.log(chars / words), math.log1p(100 * r.n_symbols / chars), math.log1p(100 * r.n_dup_lines / words), math.log1p(100 * r.n_repeat_words / words)]

    out = {}
    for r in rows:
        for own in ((lambda o: (o.lang, o.source) == (r.lang, r.source)), (lambda o: o.lang == r.lang), (lambda o: True)):
            x = np.array([vector(o) for o in rows if own(o) and not o.base_failed])
            if len(x) >= q.LEAST:
                break
        if len(x) < q.LEAST:
            out[r.doc_id] = (not r.base_failed, None)
            continue
        mean, cov, middle = fitted(x)
        off = np.array(vector(r)) - mean
        d = off @ np.linalg.solve(cov, off) * q.MEDIAN / max(middle, q.MEDIAN)
        out[r.doc_id] = (not r.base_failed and d <= q.CUTOFF, d)
    return out


def texts(sizes: dict) -> list[tuple]:
    rng, rows = random.Random(11), []
    for (lang, source), n in sizes.items():
        for k in range(n):
            words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(15, 60))]
            if rng.random() < 0.3:
                words[3] += "#"
            if k == 1:
                words = [w + "#$%&|<>" * 3 for w in words]
            text = None if k == 2 else " ".join(words) + ("\nsame line" * 2 if rng.random() < 0.2 else "")
            rows.append((len(rows), text, lang, source))
    return rows


SIZES = {("en", "big"): 45, ("en", "small"): 7, ("en", None): 4, ("de", "a"): 9, ("de", "b"): 30, ("fr", "x"): 5, (None, "big"): 6, (None, None): 3, ("it", "gone"): 1}


@pytest.mark.parametrize("sizes,judged", [(SIZES, True), ({("en", "a"): 12, ("de", "b"): 8}, False)])
def test_small_groups_are_judged_by_wider_ones(spark, sizes, judged):
    docs = spark.createDataFrame(texts(sizes), "doc_id long, text string, lang string, source string")
    rows = q.quality_outliers(docs).collect()
    want = brute(rows)
    assert len(rows) == sum(sizes.values())
    for r in rows:
        kept, d = want[r.doc_id]
        assert r.kept == kept and (r.distance is None) == (d is None) and (d is None or math.isclose(r.distance, d, rel_tol=1e-6, abs_tol=1e-6)), (r, d)
    lost = {(r.lang, r.source) for r in rows if not r.kept and not r.base_failed}
    assert lost >= ({("en", "small"), ("en", None), ("de", "a"), ("fr", "x"), (None, "big")} if judged else set())
