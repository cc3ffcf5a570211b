"""Rasters in long form, (row, col, value) on an affine grid: nearest pixels, bilinear resampling, priority mosaics, radar composites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Pixel (row, col) has its centre at (x0 + col * dx, y0 + row * dy); dy is negative for rows from the north."""

    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int

    def at(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Fractional (row, col)."""
        return (y - self.y0) / self.dy, (x - self.x0) / self.dx

    def within(self, row: Column, col: Column) -> Column:
        return row.between(0, self.rows - 1) & col.between(0, self.cols - 1)


def nearest_pixel(points: DataFrame, grid: Grid, x: Column, y: Column) -> DataFrame:
    """``points`` with the row and col of the pixel that holds them; those outside the grid or without a place go. Halves round to the even pixel, as the rule to match does."""
    row, col = [F.rint(v).cast("long") for v in grid.at(x, y)]
    return points.withColumns({"row": row, "col": col}).where(grid.within(F.col("row"), F.col("col")))


def resample(targets: DataFrame, raster: DataFrame, grid: Grid, x: Column, y: Column, keys: list[str], frame: list[str]) -> DataFrame:
    """(keys, frame, value): bilinear values of each frame of the raster at the targets' places (x, y), which may be null.

    raster: (frame, row, col, value). Pixels that are missing, null or NaN take no part, and the weights of the others are scaled up; a target with none
    has no row. Each target goes to at most four pixels, by one equi-join; sums combine before the shuffle.
    """
    row, col = grid.at(x, y)
    base = targets.select(*keys, row.alias("__r"), col.alias("__c")).where("__r > -1 and __c > -1").where((F.col("__r") < grid.rows) & (F.col("__c") < grid.cols))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    part = lambda v, k: F.when(k == 1, v - F.floor(v)).otherwise(1 - (v - F.floor(v)))
    four = base.select("*", corner.alias("k")).select(
        *keys, (F.floor("__r") + F.col("k.i")).alias("row"), (F.floor("__c") + F.col("k.j")).alias("col"), (part(F.col("__r"), F.col("k.i")) * part(F.col("__c"), F.col("k.j"))).alias("__w")
    )
    known = raster.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    met = four.where("__w > 0").join(known, ["row", "col"])
    return met.groupBy(*keys, *frame).agg((F.sum(F.col("__w") * F.col("value")) / F.sum("__w")).alias("value"))


def mosaic(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, value, layer): of each pixel the value of the first layer that has one; a layer's number starts from 0."""
    rows = None
    for k, layer in enumerate(layers):
        own = layer.where("value is not null").select(*keys, "value", F.lit(k).alias("layer"))
        rows = own if rows is None else rows.unionByName(own)
    best = rows.groupBy(*keys).agg(F.min(F.struct("layer", "value")).alias("best"))
    return best.select(*keys, "best.value", "best.layer")
