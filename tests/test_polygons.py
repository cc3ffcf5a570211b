"""Polygons on the globe against plain loops, for several cell sizes: holes, parts, the antimeridian, poles, broken rings."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from windrose.operators import polygons

RINGS = "g_id int, rings array<array<struct<lon:double,lat:double>>>"


def ring(lat, lon, radius, corners, rng=None):
    out = []
    for k in range(corners):
        r = radius * (rng.uniform(0.4, 1.0) if rng else 1.0)
        out.append(((lon + r * math.sin(2 * math.pi * k / corners) + 180) % 360 - 180, lat + r * math.cos(2 * math.pi * k / corners)))
    return out + out[:1]


def shapes():
    rng = random.Random(6)
    out = [(k, [ring(rng.uniform(-60, 60), rng.uniform(-180, 180), rng.uniform(0.2, 15), rng.randrange(3, 14), rng)]) for k in range(20)]
    out += [(20, [ring(10, 179.5, 8, 10, rng), ring(10, 179.5, 2, 5)]), (21, [ring(-20, 170, 6, 6), ring(-20, -172, 6, 6)]), (22, [[((k * 30.0 + 180) % 360 - 180, 70.0 + k % 2) for k in range(13)]])]
    return out + [(23, [[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]), (24, [None, []]), (25, None), (26, [ring(10.0, 179.0, 0.3, 4)])]


def edges(rings):
    out = []
    for points in rings or []:
        if not points or len(points) < 4:
            continue
        xs = [points[0][0]]
        for lon, _ in points[1:]:
            xs.append(xs[-1] + (lon - xs[-1] + 180) % 360 - 180)
        path = list(zip(xs, [p[1] for p in points]))
        if abs(path[-1][0] - path[0][0]) > 180:
            pole = 90.0 if sum(p[1] for p in path) >= 0 else -90.0
            path += [(path[-1][0], pole), (path[0][0], pole), path[0]]
        out += list(zip(path, path[1:]))
    return out


def inside(known, lat, lon):
    hits = 0
    for turn in (-720, -360, 0, 360, 720):
        x = lon + turn
        hits += sum((a[1] > lat) != (b[1] > lat) and x < a[0] + (lat - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in known) % 2
    return hits % 2 == 1


def crossing(e, f):
    side = lambda e, p: (e[1][0] - e[0][0]) * (p[1] - e[0][1]) - (e[1][1] - e[0][1]) * (p[0] - e[0][0])
    return side(e, f[0]) * side(e, f[1]) < 0 and side(f, e[0]) * side(f, e[1]) < 0


def meet(p, q):
    for turn in (-720, -360, 0, 360, 720):
        moved = [tuple((x + turn, y) for x, y in e) for e in q]
        if any(crossing(e, f) for e in p for f in moved):
            return True
    return any(inside(q, a[1], a[0]) for a, _ in p) or any(inside(p, a[1], a[0]) for a, _ in q)


def frame(spark, rows):
    return spark.createDataFrame([(k, r if r is None else [x if x is None else [{"lon": a, "lat": b} for a, b in x] for x in r]) for k, r in rows], RINGS)


@pytest.mark.parametrize("size", [2.0, 5.0, 30.0])
def test_points_equal_a_plain_loop(spark, size):
    rng = random.Random(9)
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(1500)] + [(i, rng.uniform(0, 20), (rng.uniform(168, 192) + 180) % 360 - 180) for i in range(1500, 2500)] + [(1, None, 0.0), (2, 0.0, None)]
    got = polygons.points_in(spark.createDataFrame(places, "p_id int, p_lat double, p_lon double"), frame(spark, shapes()), size)
    assert got.columns == ["p_id", "p_lat", "p_lon", "g_id"]
    known = {k: edges(r) for k, r in shapes()}
    want = sorted((i, k) for i, lat, lon in places if lat is not None and lon is not None for k, e in known.items() if inside(e, lat, lon))
    assert sorted((r.p_id, r.g_id) for r in got.collect()) == want
    assert {20, 21, 22} <= {k for _, k in want}


@pytest.mark.parametrize("size", [5.0, 30.0])
def test_meeting_polygons_equal_a_plain_loop(spark, size):
    rows, other = shapes(), [(100 + k, r) for k, r in shapes()[5:]] + [(200, [ring(10, -179, 12, 9)])]
    got = {tuple(r) for r in polygons.meeting(frame(spark, rows), frame(spark, other), size).where(F.col("left") != F.col("right") - 100).collect()}
    p, q = {k: edges(r) for k, r in rows}, {k: edges(r) for k, r in other}
    assert got == {(a, b) for a in p for b in q if a != b - 100 and p[a] and q[b] and meet(p[a], q[b])}


def test_inner_cells_have_no_edges_and_sizes_divide(spark):
    big = frame(spark, [(1, [ring(0, 0, 40, 12)])])
    cells = polygons.cover(big, 5.0)
    assert cells.where("inner").count() > 100 and cells.where("inner and edges is not null").isEmpty()
    with pytest.raises(ValueError):
        polygons.cover(big, 7.0)
    assert polygons.points_in(spark.createDataFrame([], "p_id int, p_lat double, p_lon double"), big).isEmpty()
