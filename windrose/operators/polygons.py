"""Points in polygons and polygons that meet, anywhere on the globe, by covers of degree cells.

A polygon is a list of closed rings of (lon, lat), together under the even-odd rule: holes and several parts are rings like any other. Rings may run
over the antimeridian (each step goes the shorter way around), and one that goes around a pole holds the nearer pole.

``cover`` cuts each polygon into rows of cells. A row keeps the edges that touch its band of latitudes; cells that an edge passes are border cells and carry
the row's edges, cells between them are inner or left out. So an inner cell needs no test of edges, and a border cell only those of its row.

Plan: one equi-join by cell. A polygon is copied once a row and cell, never its whole ring; ``size`` is a trade between copies and tests. Hot cells are split by AQE, and
their points meet only polygons over the cell.

Cases: null or empty rings and rings of fewer than four points hold nothing; points with a null are in none; a point on a border belongs to one side (half-open);
repeated rows and ids come back as they are, one row for each pair of rows in ``points_in`` and one for each pair of ids in ``meeting``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EDGE = "array<struct<ax:double,ay:double,bx:double,by:double>>"


def unrolled(ring: Column) -> Column:
    """Edges of a ring over continuous longitudes; one that goes around a pole is closed over it."""
    known = F.filter(ring, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    turn = lambda d: F.pmod(d + 180.0, F.lit(360.0)) - 180.0
    empty = F.array().cast("array<struct<x:double,y:double>>")
    # to the right of the last place, by the shorter way
    step = lambda s, p: F.concat(s, F.array(F.struct(F.when(F.size(s) == 0, turn(p["lon"].cast("double"))).otherwise(F.element_at(s, -1)["x"] + turn(p["lon"] - F.element_at(s, -1)["x"])).alias("x"), p["lat"].cast("double").alias("y"))))
    path = F.aggregate(known, empty, step)

    def edges(path: Column) -> Column:
        first, last = F.element_at(path, 1), F.element_at(path, -1)
        mean = F.aggregate(path, F.lit(0.0), lambda s, p: s + p["y"])
        pole = F.when(mean >= 0, 90.0).otherwise(-90.0)
        over = F.array(F.struct(last["x"].alias("x"), pole.alias("y")), F.struct(first["x"].alias("x"), pole.alias("y")), first)
        whole = F.when(F.abs(last["x"] - first["x"]) > 180, F.concat(path, over)).otherwise(path)
        return F.zip_with(F.slice(whole, 1, F.size(whole) - 1), F.slice(whole, 2, F.size(whole) - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    return F.when(F.size(known) >= 4, F.element_at(F.transform(F.array(path), edges), 1)).otherwise(F.array().cast(_EDGE))


def odd(edges: Column, x: Column, y: Column) -> Column:
    """Whether an odd number of edges lies to the right of a place."""
    right = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)))
    return F.size(F.filter(edges, right)) % 2 == 1


def columns_of(size: float) -> int:
    n = round(360 / size)
    if n < 1 or abs(n * size - 360) > 1e-9:
        raise ValueError("size must divide 360 degrees")
    return n


def cover(polygons: DataFrame, size: float = 5.0, id: str = "g_id", rings: str = "rings") -> DataFrame:
    """(id, cy, cx, x, inner, edges): the cells that each polygon touches; cx is the column around the globe, x the cell's western longitude on the polygon's own."""
    n = columns_of(size)
    own = polygons.select(F.col(id), F.flatten(F.transform(F.coalesce(rings, F.array().cast("array<array<struct<lon:double,lat:double>>>")), lambda r: unrolled(F.coalesce(r, F.array().cast("array<struct<lon:double,lat:double>>"))))).alias("edges")).where(F.size("edges") > 0)
    lows, highs = F.transform("edges", lambda e: F.least(e["ay"], e["by"])), F.transform("edges", lambda e: F.greatest(e["ay"], e["by"]))
    rows = own.select(id, "edges", F.explode(F.sequence(F.floor(F.array_min(lows) / size), F.floor(F.array_max(highs) / size))).alias("cy"))
    south, north = F.col("cy") * size, (F.col("cy") + 1) * size
    rows = rows.withColumn("edges", F.filter("edges", lambda e: (F.least(e["ay"], e["by"]) <= north) & (F.greatest(e["ay"], e["by"]) >= south))).where(F.size("edges") > 0)

    def passed(e: Column) -> Column:
        """Columns of cells that an edge passes within the row."""
        steep = F.nullif(e["by"] - e["ay"], F.lit(0.0))
        at = lambda y: e["ax"] + (F.least(F.greatest(y, F.least(e["ay"], e["by"])), F.greatest(e["ay"], e["by"])) - e["ay"]) * (e["bx"] - e["ax"]) / steep
        a, b = F.when(steep.isNull(), e["ax"]).otherwise(at(south)), F.when(steep.isNull(), e["bx"]).otherwise(at(north))
        return F.sequence(F.floor((F.least(a, b) - 1e-9) / size), F.floor((F.greatest(a, b) + 1e-9) / size))

    rows = rows.withColumn("border", F.array_sort(F.array_distinct(F.flatten(F.transform("edges", passed)))))
    middle = (F.col("cy") + 0.5) * size
    between = F.array_except(F.sequence(F.array_min("border"), F.array_max("border")), "border")
    inner = F.filter(between, lambda c: odd(F.col("edges"), (c + 0.5) * size, middle))
    parts = [
        F.transform("border", lambda c: F.struct(c.alias("c"), F.lit(False).alias("inner"), F.col("edges").alias("edges"))),
        F.transform(inner, lambda c: F.struct(c.alias("c"), F.lit(True).alias("inner"), F.lit(None).cast(_EDGE).alias("edges"))),
    ]
    cells = rows.select(id, "cy", F.explode(F.concat(*parts)).alias("cell"))
    return cells.select(id, "cy", F.pmod("cell.c", F.lit(n)).alias("cx"), (F.col("cell.c") * size).alias("x"), "cell.inner", "cell.edges")


def points_in(points: DataFrame, polygons: DataFrame, size: float = 5.0, lat: str = "p_lat", lon: str = "p_lon", id: str = "g_id", rings: str = "rings") -> DataFrame:
    """``points`` with the id of each polygon that holds them."""
    n = columns_of(size)
    own = points.withColumns({"__cy": F.floor(F.col(lat) / size), "__cx": F.pmod(F.floor(F.col(lon) / size), F.lit(n))})
    cells = cover(polygons, size, id, rings).select(F.col(id).alias("__id"), F.col("cy").alias("__cy"), F.col("cx").alias("__cx"), F.col("x").alias("__x"), F.col("inner").alias("__inner"), F.col("edges").alias("__edges"))
    # the point's longitude as the polygon counts it
    x = F.col(lon) + 360.0 * F.round((F.col("__x") + size / 2 - F.col(lon)) / 360.0)
    found = own.join(cells, ["__cy", "__cx"]).where(F.col("__inner") | odd(F.col("__edges"), x, F.col(lat)))
    return found.select(*points.columns, F.col("__id").alias(id))


def meeting(left: DataFrame, right: DataFrame, size: float = 5.0, id: str = "g_id", rings: str = "rings") -> DataFrame:
    """(left, right): ids of polygons that share a place; borders that only touch in a point may or may not count.

    A cell inside one of them and touched by the other settles a pair. In a cell on both borders edges must cross, or a corner of one lie in the other.
    """
    a = cover(left, size, id, rings).select(F.col(id).alias("left"), "cy", "cx", F.col("x").alias("ax"), F.col("inner").alias("a_inner"), F.col("edges").alias("a"))
    b = cover(right, size, id, rings).select(F.col(id).alias("right"), "cy", "cx", F.col("x").alias("bx"), F.col("inner").alias("b_inner"), F.col("edges").alias("b"))
    south, north = F.col("cy") * size, (F.col("cy") + 1) * size
    shift = F.col("ax") - F.col("bx")
    moved = F.transform("b", lambda e: F.struct((e["ax"] + shift).alias("ax"), e["ay"].alias("ay"), (e["bx"] + shift).alias("bx"), e["by"].alias("by")))
    side = lambda e, x, y: F.signum((e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"]))
    apart = lambda e, f: side(e, f["ax"], f["ay"]) * side(e, f["bx"], f["by"]) < 0
    cross = F.exists("a", lambda e: F.exists("b2", lambda f: apart(e, f) & apart(f, e)))
    within = lambda these, those: F.exists(these, lambda e: e["ay"].between(south, north) & odd(F.col(those), e["ax"], e["ay"]))
    met = a.join(b, ["cy", "cx"]).withColumn("b2", moved)
    sure = F.col("a_inner") | F.col("b_inner")
    return met.where(sure | cross | within("a", "b2") | within("b2", "a")).select("left", "right").distinct()
