"""The surface through scattered points against all triples of points, for several cell sizes."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from windrose.operators.surface import surface, weights


def brute(points, lats, lons):
    """Each node by every triangle that holds it and whose circle is empty."""
    places = {}
    for lat, lon, v in points:
        if None not in (lat, lon, v):
            places.setdefault((lat, lon), []).append(v)
    known = [(lat, lon, sum(v) / len(v)) for (lat, lon), v in sorted(places.items())]
    p = np.array(known).reshape(-1, 3)
    z = p[:, 0] ** 2 + p[:, 1] ** 2 + weights(p[:, 0], p[:, 1])
    good = []
    for t in itertools.combinations(range(len(p)), 3):
        m = np.array([p[list(t), 1], p[list(t), 0], [1, 1, 1]])
        if abs(np.linalg.det(m)) < 1e-9:
            continue
        inverse = np.linalg.inv(m)
        if (z - z[list(t)] @ inverse @ np.array([p[:, 1], p[:, 0], np.ones(len(p))]) > -1e-9).all():
            good.append((list(t), inverse))
    out = {}
    axis = lambda a: [a[0] + i * a[2] for i in range(round((a[1] - a[0]) / a[2]) + 1)]
    for glat in axis(lats):
        for glon in axis(lons):
            hits = [float(s @ p[t, 2]) for t, inverse in good if ((s := inverse @ [glon, glat, 1]) >= -1e-9).all()]
            if hits:
                out[round(glat, 6), round(glon, 6)] = hits[0], True
            elif len(p):
                out[round(glat, 6), round(glon, 6)] = float(p[np.argmin((p[:, 0] - glat) ** 2 + (p[:, 1] - glon) ** 2), 2]), False
            else:
                out[round(glat, 6), round(glon, 6)] = None, False
    return out


def clustered():
    rng = random.Random(8)
    spread = [(round(rng.uniform(20, 60), 2), round(rng.uniform(-30, 30), 2), rng.uniform(0, 50)) for _ in range(18)]
    return spread + [(40 + rng.random(), 3 + rng.random(), 100.0) for _ in range(12)] + [(40.5, 3.5, None), (None, 3.5, 1.0), spread[0][:2] + (7.0,)]


@pytest.mark.parametrize("size", [3.0, 20.0])
def test_equals_all_triangles_for_any_cells(spark, size):
    points = clustered()
    got = {(round(r.glat, 6), round(r.glon, 6)): (r.value, r.inside) for r in surface(spark.createDataFrame(points, "lat double, lon double, v double"), (15, 65, 4.3), (-35, 35, 4.7), size).collect()}
    want = brute(points, (15, 65, 4.3), (-35, 35, 4.7))
    assert got.keys() == want.keys()
    for k, (value, inside) in want.items():
        assert got[k][1] == inside and abs(got[k][0] - value) < 1e-6, (k, got[k], want[k])


@pytest.mark.parametrize("points", [[], [(1.0, 1.0, 5.0)], [(1.0, 1.0, 5.0), (2.0, 2.0, 6.0), (3.0, 3.0, 7.0)], [(float(i), float(j), float(i * 7 + j)) for i in range(4) for j in range(4)]])
def test_few_points_lines_and_lattices(spark, points):
    got = {(r.glat, r.glon): (r.value, r.inside) for r in surface(spark.createDataFrame(points, "lat double, lon double, v double"), (-1, 5, 0.75), (-1, 5, 0.75)).collect()}
    if len(points) == 16:  # a plane, whichever way its squares are cut
        inner = {k: v for k, v in got.items() if 0 <= k[0] <= 3 and 0 <= k[1] <= 3}
        assert all(i and abs(v - (7 * a + b)) < 1e-6 for (a, b), (v, i) in inner.items() if 0 < a < 3 and 0 < b < 3)
    else:
        want = {(a, b): v for (a, b), v in brute(points, (-1, 5, 0.75), (-1, 5, 0.75)).items()}
        if len(points) == 3:  # all of the hull is a line
            want |= {(a, a): (4 + a, True) for a in (1.25, 2.0, 2.75)}
        assert got == want
    assert len(got) == 81


def test_small_cells_are_refused(spark):
    with pytest.raises(ValueError):
        surface(spark.createDataFrame([], "lat double, lon double, v double"), (0, 1, 1), (0, 1, 1), 0.5)
