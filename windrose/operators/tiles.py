"""Map tiles of rasters in long form: nearest samples at a zoom's pixels, and overviews rolled up zoom by zoom.

At a zoom the world is 2**zoom tiles wide and high, in Web Mercator, each of ``side`` pixels a side. Pixel (px, py) counts from the world's north-west
corner; tile x is px div side, y is py div side. Within a tile, rows are spaced evenly in latitude, as the rule to match has it. Pixels off the
raster, or on missing, null or NaN values, have no row, and hence a tile without any value has none. Longitudes may run from 0 to 360 or across the antimeridian.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import Grid

SIDE = 256


def edge_latitude(y: Column, zoom: int) -> Column:
    """Of the northern edge of tiles' row ``y``."""
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / F.lit(float(2**zoom))))))


def samples(raster: DataFrame, grid: Grid, zoom: int, frame: list[str] | None = None, side: int = SIDE) -> DataFrame:
    """(frame, px, py, value) of every pixel of the zoom that has a value: that of the raster's nearest node.

    raster: (frame, row, col, value). A pixel's column depends on px alone and its row on py alone, so the raster meets two lists of a world's width:
    two equi-joins that make nothing but the result.
    """
    frame = frame or []
    line = raster.sparkSession.range(side << zoom)
    lon = (F.col("id") + 0.5) / F.lit(float(side << zoom)) * 360 - 180
    east = F.pmod(lon - grid.x0 + abs(grid.dx) / 2, F.lit(360.0)) - abs(grid.dx) / 2
    tile, j = F.floor(F.col("id") / side), F.col("id") % side
    top, bottom = edge_latitude(tile, zoom), edge_latitude(tile + 1, zoom)
    lat = top - (j + 0.5) / F.lit(float(side)) * (top - bottom)
    cols = line.select(F.rint(east / grid.dx).cast("long").alias("col"), F.col("id").alias("px")).where(F.col("col").between(0, grid.cols - 1))
    rows = line.select(F.rint((lat - grid.y0) / grid.dy).cast("long").alias("row"), F.col("id").alias("py")).where(F.col("row").between(0, grid.rows - 1))
    known = raster.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).select(*frame, "row", "col", "value")
    return known.join(cols, "col").join(rows, "row").select(*frame, "px", "py", "value")


def overviews(base: DataFrame, zoom: int, least: int, frame: list[str] | None = None, share: float = 0.0) -> DataFrame:
    """(frame, zoom, px, py, known, mean, top): ``base``, the pixels of ``zoom``, and those of every zoom down to ``least``, each from the one below it.

    ``known`` counts the pixels of ``base`` that have a value, ``mean`` and ``top`` are over those. A pixel of which less than ``share`` is known has no row, but what is
    known of it goes on into its parent. A zoom is a quarter of the one below, and all read the same shuffles, so the whole pyramid costs a third more than its base.
    """
    frame = frame or []
    level = base.select(*frame, "px", "py", F.lit(1).cast("long").alias("known"), F.col("value").cast("double").alias("total"), F.col("value").alias("top"))
    levels = []
    for z in range(zoom, least - 1, -1):
        if z < zoom:
            parent = [F.shiftright(c, 1).alias(c) for c in ("px", "py")]
            level = level.groupBy(*frame, *parent).agg(F.sum("known").alias("known"), F.sum("total").alias("total"), F.max("top").alias("top"))
        enough = level.where(F.col("known") >= F.lit(share * 4 ** (zoom - z)))
        levels.append(enough.select(*frame, F.lit(z).alias("zoom"), "px", "py", "known", (F.col("total") / F.col("known")).alias("mean"), "top"))
    return reduce(DataFrame.unionByName, levels)


def tile_index(pixels: DataFrame, keys: list[str], side: int = SIDE) -> DataFrame:
    """(keys, x, y, known): tiles that have a value, and how many of their pixels have one."""
    place = [F.floor(F.col(p) / side).cast("long").alias(t) for p, t in (("px", "x"), ("py", "y"))]
    return pixels.groupBy(*keys, *place).agg(F.count("*").alias("known"))


def shade(value: Column, low: float, high: float, entries: int = 4096) -> Column:
    """The entry of a colour table that spreads from ``low`` to ``high``; values beyond take its ends."""
    part = F.least(F.greatest((value - low) / F.lit(float(high - low)), F.lit(0.0)), F.lit(1.0))
    return F.floor(part * (entries - 1)).cast("int")
