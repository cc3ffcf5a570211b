"""Radar composites against a plain loop over bins and samples."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from windrose.operators import radar

SCHEMA = "radar long, lat double, lon double, azimuth double, beam double, bin long, value int, frame string"


def brute(rows, canvas, bin_km, range_km):
    best, seen = {}, {}
    for name, lat, lon, azimuth, beam, b, value, frame in rows:
        if value is None or value <= 1 or (b + 0.5) * bin_km > range_km or abs(lat) >= 90:
            continue
        n = max(2, min(8, int(beam / 0.25) + 2))
        for i in range(n):
            a, km = math.radians(azimuth + beam * i / (n - 1)), (b + 0.5) * bin_km
            y, x = lat + km * math.cos(a) / 111.32, lon + km * math.sin(a) / (111.32 * math.cos(math.radians(lat)))
            off = (x - canvas.west) % 360
            if canvas.south <= y <= canvas.north and off < canvas.width:
                key = frame, math.floor((canvas.north - y) / canvas.step), math.floor(off / canvas.step)
                best[key] = max(best.get(key, 0), value)
                seen.setdefault(key, set()).add(name)
    return sorted((*k, v, len(seen[k])) for k, v in best.items())


@pytest.mark.parametrize("canvas", [radar.Canvas(-100, 30, -90, 40, 0.1), radar.Canvas(175, -5, -175, 5, 0.2), radar.Canvas(-180, 60, 180, 90, 1.0)])
def test_equals_plain_loop(spark, canvas):
    rng = random.Random(2)
    places = [(canvas.south + rng.random() * 3, canvas.west + 5 + d) for d in (-1.0, 0.0, 1.1)] + [(90.0, 0.0)]
    rows = []
    for k, (lat, lon) in enumerate(places):
        for _ in range(300):
            rows.append((k, lat, (lon + 180) % 360 - 180, rng.uniform(0, 360), rng.choice([0.25, 0.5, 1.0, 3.0]), rng.randrange(240), rng.choice([None, 0, 1, 2, 40, 75]), rng.choice("ab")))
    rows += rows[:20]
    out = radar.composite(spark.createDataFrame(rows, SCHEMA), canvas, bin_km=1.0, frame=["frame"])
    assert sorted(tuple(r) for r in out.select("frame", "row", "col", "value", "radars").collect()) == brute(rows, canvas, 1.0, 230.0)


def test_overlap_takes_the_larger_in_any_order(spark):
    rows = [(1, 35.0, -95.0, 90.0, 0.5, 40, 30, "a"), (2, 35.0, -95.0, 90.0, 0.5, 40, 60, "a"), (3, 35.0, -95.0, 90.0, 0.5, 40, 45, "a")]
    canvas = radar.Canvas(-100, 30, -90, 40, 0.5)
    for order in (rows, rows[::-1]):
        got = radar.composite(spark.createDataFrame(order, SCHEMA), canvas).agg(F.min("value"), F.max("value"), F.max("radars")).first()
        assert tuple(got) == (60, 60, 3)
    assert radar.composite(spark.createDataFrame([], SCHEMA), canvas).isEmpty()
