"""Projections by round trips and known places; resampling and mosaics on hand-written rasters."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from windrose.functions.projection import Geostationary, Lambert
from windrose.operators import raster

PLACES = [(lat, lon) for lat in (-35.0, 0.0, 24.5, 38.5, 61.25) for lon in (-140.0, -97.5, -66.1, -20.0)]


@pytest.mark.parametrize("view", [Lambert(), Lambert(25, -95, 25, 60), Lambert(-30, 140, -20, -45), Geostationary(-75), Geostationary(-137)])
def test_round_trip(spark, view):
    df = spark.createDataFrame(PLACES, "lat double, lon double").withColumn("at", view.xy(F.col("lat"), F.col("lon"))).where("at is not null")
    rows = df.withColumn("back", view.place(F.col("at.x"), F.col("at.y"))).collect()
    assert len(rows) >= 8
    for r in rows:
        assert abs(r.back.lat - r.lat) < 1e-9 and abs((r.back.lon - r.lon + 180) % 360 - 180) < 1e-9


def test_known_places(spark):
    one = spark.range(1)
    got = one.select(Lambert().xy(F.lit(38.5), F.lit(-97.5)).alias("a"), Geostationary().xy(F.lit(0.0), F.lit(-75.0)).alias("b"), Geostationary().xy(F.lit(0.0), F.lit(105.0)).alias("c"), Geostationary().place(F.lit(0.5), F.lit(0.0)).alias("d"), Lambert().xy(F.lit(-90.0), F.lit(0.0)).alias("e"), Lambert().place(F.lit(0.0), F.lit(Lambert()._cone()[2])).alias("f"), Lambert(lon0=179.0).xy(F.lit(38.5), F.lit(-179.0)).alias("g")).first()
    assert abs(got.a.x) < 1e-6 and abs(got.a.y) < 1e-6 and abs(got.b.x) < 1e-12 and got.c is None and got.d is None and got.e is None
    assert got.f.lat == 90.0 and got.g.x > 0  # two degrees to the east, over the antimeridian
    # from the user's guide of the instruments: this scan angle is this place
    place = one.select(Geostationary().place(F.lit(-0.024052), F.lit(0.095340)).alias("p")).first().p
    assert abs(place.lat - 33.846162) < 1e-5 and abs(place.lon + 84.690932) < 1e-5


def test_resampling_skips_missing_pixels(spark):
    grid = raster.Grid(0.0, 10.0, 1.0, -1.0, 3, 3)
    rows = [(r, c, float(10 * r + c)) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(1, 1, float("nan"))]
    source = spark.createDataFrame([(*x, "a") for x in rows] + [(0, 0, None, "b")], "row long, col long, value double, frame string")
    targets = spark.createDataFrame([(1, 0.5, 10.0), (2, 1.0, 9.0), (3, 0.5, 9.5), (4, 2.5, 8.0), (5, 3.0, 8.0), (6, None, 8.0), (7, -0.5, 10.5)], "id int, x double, y double")
    got = {r.id: r.value for r in raster.resample(targets, source, grid, F.col("x"), F.col("y"), ["id"], ["frame"]).collect()}
    assert got == pytest.approx({1: 0.5, 3: (0 + 1 + 10) / 3, 4: 22.0, 7: 0.0})


def test_nearest_pixel_and_mosaic(spark):
    grid = raster.Grid(0.0, 0.0, 1.0, 1.0, 3, 3)
    points = spark.createDataFrame([(1, 0.5, 1.5), (2, 2.6, 0.0), (3, -0.5, 0.0), (4, None, 0.0)], "id int, x double, y double")
    got = {r.id: (r.row, r.col) for r in raster.nearest_pixel(points, grid, F.col("x"), F.col("y")).collect()}
    assert got == {1: (2, 0), 3: (0, 0)}  # halves to the even pixel, 2.6 is off the grid
    a = spark.createDataFrame([(1, 5.0), (2, None)], "id int, value double")
    b = spark.createDataFrame([(1, 6.0), (2, 7.0), (3, 8.0)], "id int, value double")
    assert sorted(tuple(r) for r in raster.mosaic([a, b], ["id"]).collect()) == [(1, 5.0, 0), (2, 7.0, 1), (3, 8.0, 1)]
    assert math.isclose(raster.mosaic([a.limit(0), b], ["id"]).agg(F.sum("value")).first()[0], 21.0)
