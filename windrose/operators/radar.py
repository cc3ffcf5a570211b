"""Radar composites: polar bins painted on a latitude and longitude grid, the largest value of all radars in each cell."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bin's length and the clipped range in kilometres, kilometres of a degree, degrees between samples across a beam, and how many samples at least and most.
BIN_KM, RANGE_KM, DEGREE_KM, SAMPLE, LEAST, MOST = 0.25, 230.0, 111.32, 0.25, 2, 8


@dataclass(frozen=True)
class Canvas:
    """Cells of ``step`` degrees, rows from the north and columns to the east; east below west is over the antimeridian."""

    west: float
    south: float
    east: float
    north: float
    step: float

    @property
    def width(self) -> float:
        return (self.east - self.west) % 360.0 or 360.0

    def cell(self, lat: Column, lon: Column) -> tuple[Column, Column, Column]:
        """(row, col, inside)."""
        off = F.pmod(lon - self.west, F.lit(360.0))
        row, col = F.floor((self.north - lat) / self.step), F.floor(off / self.step)
        return row, col, lat.between(self.south, self.north) & (off < self.width)


def samples(azimuth: Column, beam: Column) -> Column:
    """Azimuths across a beam, both of its borders among them: as many as its width asks for."""
    n = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.floor(beam / SAMPLE) + 2)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: azimuth + beam * i / (n - 1))


def composite(bins: DataFrame, canvas: Canvas, bin_km: float = BIN_KM, range_km: float = RANGE_KM, frame: list[str] | None = None) -> DataFrame:
    """(frame, row, col, value, radars) of each cell that a bin of a value above 1 touches.

    bins: (radar, lat, lon, azimuth, beam, bin, value), lat and lon being the radar's; azimuth is where the beam of ``beam`` degrees begins. Each bin
    is painted at its middle range along samples across its beam, on the plane around its radar. ``radars`` counts those that see the cell.

    A bin becomes at most ``MOST`` cells, of which equal ones fall at once; the maximum is first taken by radar and cell, which combines in each task, then
    by cell, so many radars over one cell don't meet as rows. Nulls, values of 1 or less and bins beyond the range paint nothing; a radar at a pole paints nothing.
    """
    frame = frame or []
    known = bins.where((F.col("value") > 1) & ((F.col("bin") + 0.5) * bin_km <= range_km) & (F.abs("lat") < 90))
    km = (F.col("bin") + 0.5) * bin_km

    def at(a: Column) -> Column:
        lat = F.col("lat") + km * F.cos(F.radians(a)) / DEGREE_KM
        lon = F.col("lon") + km * F.sin(F.radians(a)) / (DEGREE_KM * F.cos(F.radians("lat")))
        row, col, inside = canvas.cell(lat, lon)
        return F.when(inside, F.struct(row.alias("row"), col.alias("col")))

    touched = F.array_distinct(F.transform(samples(F.col("azimuth"), F.col("beam")), at))
    cells = known.select(*frame, "radar", "value", F.explode(touched).alias("cell")).where("cell is not null")
    by_radar = cells.groupBy(*frame, "cell.row", "cell.col", "radar").agg(F.max("value").alias("value"))
    return by_radar.groupBy(*frame, "row", "col").agg(F.max("value").alias("value"), F.count("*").alias("radars"))
