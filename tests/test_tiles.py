"""Map tiles against plain loops; overviews against direct sums."""

from __future__ import annotations

import math

import pytest

from windrose.operators import tiles
from windrose.operators.raster import Grid

SIDE = 8


def plain(values, grid, zoom):
    """Every pixel of the world, one by one."""
    edge = lambda y: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 2**zoom))))
    out = {}
    for py in range(SIDE << zoom):
        y, j = divmod(py, SIDE)
        lat = edge(y) - (j + 0.5) / SIDE * (edge(y) - edge(y + 1))
        for px in range(SIDE << zoom):
            lon = (px + 0.5) / (SIDE << zoom) * 360 - 180
            for turn in (-360, 0, 360):
                at = round((lat - grid.y0) / grid.dy), round((lon + turn - grid.x0) / grid.dx)
                value = values.get(at)
                if value is not None and not math.isnan(value):
                    out[px, py] = value
    return out


@pytest.mark.parametrize("x0", [-60.3, 150.3, 200.7])  # by itself, across the antimeridian, counted from 0 to 360
def test_samples_equal_plain_loops(spark, x0):
    grid = Grid(x0, 61.7, 5.3, -4.1, 9, 14)
    values = {(r, c): float(r * 100 + c) for r in range(9) for c in range(14) if (r + c) % 5}
    values[2, 2], values[3, 4] = math.nan, None
    rows = [("a", r, c, v) for (r, c), v in values.items()] + [("b", 0, 0, 1.0)]
    raster = spark.createDataFrame(rows, "frame string, row long, col long, value double")
    found = tiles.samples(raster, grid, 3, ["frame"], SIDE).collect()
    assert {(r.px, r.py): r.value for r in found if r.frame == "a"} == plain(values, grid, 3)
    assert {(r.px, r.py): r.value for r in found if r.frame == "b"} == plain({(0, 0): 1.0}, grid, 3)
    assert len(found) == len({(r.frame, r.px, r.py) for r in found})
    assert tiles.samples(raster.limit(0), grid, 3, ["frame"], SIDE).isEmpty()


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_overviews_equal_direct_sums(spark, share):
    base = {(px, py): float(px * 31 % 17 - py) for px in range(3, 40) for py in range(5, 33) if (px * py) % 3}
    pixels = spark.createDataFrame([(x, y, v) for (x, y), v in base.items()], "px long, py long, value double")
    want = {}
    for z in range(6, 1, -1):
        below = {}
        for (x, y), v in base.items():
            below.setdefault((x >> 6 - z, y >> 6 - z), []).append(v)
        want |= {(z, x, y): (len(v), sum(v) / len(v), max(v)) for (x, y), v in below.items() if len(v) >= share * 4 ** (6 - z)}
    got = {(r.zoom, r.px, r.py): (r.known, r.mean, r.top) for r in tiles.overviews(pixels, 6, 2, share=share).collect()}
    assert got == want


def test_index_and_shades(spark):
    pixels = spark.createDataFrame([(0, 0, 1.0), (255, 1, 2.0), (256, 0, 3.0), (256, 300, 9.0)], "px long, py long, value double")
    assert sorted(map(tuple, tiles.tile_index(pixels, []).collect())) == [(0, 0, 2), (1, 0, 1), (1, 1, 1)]
    assert [r[0] for r in pixels.orderBy("value").select(tiles.shade(pixels["value"], 2, 4, 11)).collect()] == [0, 0, 5, 10]
