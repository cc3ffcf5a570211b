"""A surface through scattered points: linear within the triangles of their Delaunay triangulation, the nearest point's value outside their hull.

A grid node's triangle is found without building the triangulation: of all triangles that hold the node, the Delaunay triangle is the one
whose corners, lifted to the height lat^2 + lon^2, lie lowest over the node. That is a linear programme of three variables, and a few
exchanges of corners solve it. Its optimum also says which circle must be empty.

Points are grouped by cells of ``size`` degrees, nodes by tiles of the same size. A tile starts with the points of the occupied cells nearest to it. A
node is done when every occupied cell that its circle touches is among those of its tile; else the tile takes the nearest of the missing
cells and its open nodes go into another round. So results don't depend on cells or tiles, only points near a tile travel to it, and rounds
follow the sparsest part of the map (two to six on the test tables). Occupied cells are at most 64,800 for cells of a degree, which bounds what is broadcast.

Cases: rows with a null are left out; the mean stands for points of one place; four or more points on one circle are told apart by weights below
1e-7 square degrees that follow from the place; nodes on a border belong to either side, with equal values; the hull holds its border, so of points on one line
the nodes between them are inside; no points give null values. Longitudes don't wrap: a surface over the antimeridian takes longitudes beyond 180.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep

#: Cells that a tile begins with, and by how many at most an open node enlarges them in a round.
FIRST, MORE = 12, 16
#: Of a triangle around everything: half its size in degrees, and the height of its corners, which no surface of real points can reach.
FAR, HIGH = 1000.0, 1e10
_NODES = "tile long, glat double, glon double, value double, inside boolean, cells array<long>"


def weights(lat, lon):
    """Tie-breaking heights; also stated in the query's SQL."""
    t = lat * 12.9898 + lon * 78.233
    return 1e-7 * (t - np.floor(t))


def lowest(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corners, shares, plane) of the lowest triangle over the origin; the last three points hold it."""
    basis = np.arange(len(x) - 3, len(x))
    rows = np.stack([x, y, np.ones_like(x)])
    for _ in range(10_000):
        inverse = np.linalg.inv(rows[:, basis])
        shares = inverse[:, 2]
        plane = z[basis] @ inverse
        above = z - plane @ rows
        enters = int(np.argmin(above))
        if enters in basis or above[enters] > -1e-12 * (1 + np.abs(plane).max()):
            return basis, shares, plane
        step = inverse @ rows[:, enters]
        ratio = np.where(step > 1e-13, shares / np.where(step > 1e-13, step, 1), np.inf)
        basis[int(np.argmin(ratio))] = enters
    raise ArithmeticError("no triangle after 10,000 exchanges")


def solve(nodes: pd.DataFrame, points: pd.DataFrame, cells: np.ndarray, boxes: np.ndarray) -> pd.DataFrame:
    """Values of a tile's nodes from the points of some cells; ``cells`` of a node that is open are what it misses, nearest first.

    cells, boxes: the occupied cells and their south, west, north, east.
    """
    points = points.sort_values(["lat", "lon"])
    lat, lon, v = points["lat"].to_numpy(), points["lon"].to_numpy(), points["v"].to_numpy()
    missing = ~np.isin(cells, points["cell"].unique())
    corners = FAR * np.array([[-2.0, -1.0], [2.0, -1.0], [0.0, 2.0]])
    height = weights(lat, lon)
    out = []
    for glat, glon in zip(nodes["glat"], nodes["glon"]):
        # a shift that keeps nodes off borders and corners
        x, y = lon - glon - 1.3e-9, lat - glat - 0.7e-9
        far = x * x + y * y
        basis, shares, plane = lowest(np.append(x, corners[:, 0]), np.append(y, corners[:, 1]), np.append(far + height, [HIGH] * 3))
        south, west, north, east = (boxes[missing] - [glat, glon, glat, glon]).T
        inside = bool((shares[basis >= len(x)] < 1e-11).all())
        # the circle's point of each box that is deepest within the circle
        dx, dy = np.clip(plane[0] / 2, west, east), np.clip(plane[1] / 2, south, north)
        open_ = dx * dx + dy * dy - plane[0] * dx - plane[1] * dy - plane[2] < 1e-9 * (1 + np.abs(plane).max())
        near = np.clip(0, west, east) ** 2 + np.clip(0, south, north) ** 2
        value = None
        if inside:
            real = basis < len(x)
            value = round(float(shares[real] @ v[basis[real]]), 6)
        elif len(x):
            plain = (lon - glon) ** 2 + (lat - glat) ** 2
            value = round(float(v[np.argmin(plain)]), 6)
            open_ |= near <= plain.min()
        wanted = cells[missing][open_][np.argsort(near[open_], kind="stable")][:MORE]
        out.append((glat, glon, value, inside, wanted.tolist()))
    found = pd.DataFrame(out, columns=["glat", "glon", "value", "inside", "cells"])
    found.insert(0, "tile", nodes["tile"].iloc[0])
    return found


def surface(points: DataFrame, lats: tuple[float, float, float], lons: tuple[float, float, float], size: float = 5.0) -> DataFrame:
    """(glat, glon, value, inside) of every grid node; lats, lons: first, last, step. points: (lat, lon, v)."""
    if size < 1:
        raise ValueError("cells are of a degree at least")
    spark, wide = points.sparkSession, 1 << 20
    cell = lambda lat, lon: (F.floor(F.col(lat) / size) * wide + F.floor(F.col(lon) / size)).cast("long")
    kept = points.select(*[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "v")]).where("lat is not null and lon is not null and v is not null")
    places = keep(kept.groupBy("lat", "lon").agg(F.avg("v").alias("v")).withColumn("cell", cell("lat", "lon")))
    cells = np.array(sorted(r[0] for r in places.select("cell").distinct().collect()), np.int64)
    row = (cells + wide // 2) // wide
    corner = np.stack([row, cells - row * wide], 1) * size
    boxes = np.concatenate([corner, corner + size], 1)
    sent = spark.sparkContext.broadcast((cells, boxes))

    axis = lambda a: f"transform(sequence(0, {round((a[1] - a[0]) / a[2])}), i -> cast({a[0]} + i * {a[2]} as double))"
    nodes = spark.range(1).select(F.explode(F.expr(axis(lats))).alias("glat")).withColumn("glon", F.explode(F.expr(axis(lons))))
    if not len(cells):
        return nodes.select("*", F.lit(None).cast("double").alias("value"), F.lit(False).alias("inside"))
    left = nodes.select(cell("glat", "glon").alias("tile"), "glat", "glon")

    def begin(batches):
        known, own = sent.value
        for tiles in batches:
            for tile in tiles["tile"]:
                y = (tile + wide // 2) // wide
                gap = np.abs(own[:, :2] - np.array([y, tile - y * wide]) * size).max(1)
                yield pd.DataFrame({"tile": tile, "cell": known[np.argsort(gap, kind="stable")[:FIRST]]})

    needs, done = keep(left.select("tile").distinct().mapInPandas(begin, "tile long, cell long")), []
    while True:
        loaded = needs.join(places, "cell").select("tile", "cell", "lat", "lon", "v")
        tile = lambda own, near: solve(own, near, *sent.value) if len(own) else pd.DataFrame(columns=["tile", "glat", "glon", "value", "inside", "cells"])
        found = keep(left.groupBy("tile").cogroup(loaded.groupBy("tile")).applyInPandas(tile, _NODES))
        done.append(found.where(F.size("cells") == 0))
        left = found.where(F.size("cells") > 0)
        more = left.select("tile", F.explode("cells").alias("cell"))
        if more.isEmpty():
            break
        needs = keep(needs.join(left.select("tile").distinct(), "tile", "left_semi").unionByName(more).distinct())
        left = left.select("tile", "glat", "glon")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("glat", "glon", "value", "inside")
