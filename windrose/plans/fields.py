"""Named queries on fields: surfaces through scattered points, raster mosaics, radar composites, map tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projection import Geostationary, Lambert
from ..operators import tiles
from ..operators.radar import Canvas, composite
from ..operators.raster import Grid, mosaic, nearest_pixel, resample
from ..operators.surface import surface
from .roles import role, sql
from .weather import QUERIES, query


def wind_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Strongest wind of each airport as a surface over the whole map. No SQL: its test is against all triples of points."""
    worst = role(spark, sf, "winds").groupBy("station_id").agg(F.max("speed").alias("v"))
    points = role(spark, sf, "airports").join(worst, "station_id").select("lat", "lon", "v")
    return surface(points, (24, 50, 1), (-125, -66, 1)).select("glat", "glon", F.round("value", 4).alias("value"), "inside")


QUERIES["wind_surface"] = wind_surface

_CENTRES = """, centre as (select region, round(avg(lat), 4) as lat, round(avg(lon), 4) as lon, round(avg(speed), 4) as v from winds w join airports a on w.station_id = a.station_id group by region)"""
_LIFTED = ", p as (select lat, lon, avg(v) as v, lat * lat + lon * lon + 1e-7 * (lat * 12.9898 + lon * 78.233 - floor(lat * 12.9898 + lon * 78.233)) as z, row_number() over (order by lat, lon) as i from centre group by lat, lon)"
#: Shares of the corners a, b, c of a triangle at a place q.
_SHARES = "((b.lon - c.lon) * ({q}.lat - c.lat) - (b.lat - c.lat) * ({q}.lon - c.lon)) / t.d as sa, ((c.lon - a.lon) * ({q}.lat - c.lat) - (c.lat - a.lat) * ({q}.lon - c.lon)) / t.d as sb"
REGION_SURFACE = f"""{_CENTRES}{_LIFTED},
t as (select a.i as ia, b.i as ib, c.i as ic, (b.lon - c.lon) * (a.lat - c.lat) - (b.lat - c.lat) * (a.lon - c.lon) as d from p a join p b on a.i < b.i join p c on b.i < c.i),
below as (select ia, ib, ic, q.z - (sa * za + sb * zb + (1 - sa - sb) * zc) as gap from (select ia, ib, ic, a.z as za, b.z as zb, c.z as zc, q.z, {_SHARES.format(q="q")} from t join p a on a.i = ia join p b on b.i = ib join p c on c.i = ic cross join p q where abs(t.d) > 1e-9) q),
good as (select t.ia, t.ib, t.ic, t.d from t where abs(d) > 1e-9 and (t.ia, t.ib, t.ic) not in (select (ia, ib, ic) from below where gap < -1e-9)),
g as (select cast(24 + i * 2 as double) as lat, cast(-125 + j * 2 as double) as lon from range(0, 14) x(i), range(0, 31) y(j)),
hit as (select g.lat, g.lon, sa * av + sb * bv + (1 - sa - sb) * cv as v from (select g.lat, g.lon, a.v as av, b.v as bv, c.v as cv, {_SHARES.format(q="g")} from good t join p a on a.i = ia join p b on b.i = ib join p c on c.i = ic cross join g) g where sa >= -1e-9 and sb >= -1e-9 and sa + sb <= 1 + 1e-9),
near as (select g.lat, g.lon, min_by(p.v, (p.lat - g.lat) * (p.lat - g.lat) + (p.lon - g.lon) * (p.lon - g.lon)) as v from g, p group by g.lat, g.lon)
select n.lat as glat, n.lon as glon, round(coalesce(max(h.v), any_value(n.v)), 3) as value, max(h.v) is not null as inside from near n left join hit h on h.lat = n.lat and h.lon = n.lon group by n.lat, n.lon"""


@query(REGION_SURFACE, "winds", "airports")
def region_wind_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Mean wind of each region, at the mean place of its airports' winds, as a surface."""
    rows = role(spark, sf, "winds").join(role(spark, sf, "airports"), "station_id")
    centres = rows.groupBy("region").agg(*[F.round(F.avg(c), 4).alias(n) for c, n in (("lat", "lat"), ("lon", "lon"), ("speed", "v"))])
    return surface(centres, (24, 50, 2), (-125, -65, 2)).select("glat", "glon", F.round("value", 3).alias("value"), "inside")


#: The view of two satellites as rasters of 40 x 70 pixels, made of orders' lines: the side, the pixel and the frame follow from keys.
_RASTER = "select l_linenumber % 2 as side, cast(l_orderkey % 40 as bigint) as row, cast(l_partkey % 70 as bigint) as col, round(avg(l_quantity), 4) as value from lineitem group by 1, 2, 3"
EAST, WEST = Geostationary(-75.0), Geostationary(-137.0)
EAST_GRID, WEST_GRID = Grid(-0.105, 0.13, 0.002, -0.002, 40, 70), Grid(-0.03, 0.13, 0.002, -0.002, 40, 70)


def _view(x0: float, lon0: float) -> str:
    return f"""select lat, lon, (0.13 - atan(north / ahead)) / 0.002 as r, (asin(-west / sqrt(ahead * ahead + west * west + north * north)) - ({x0})) / 0.002 as c from (
  select lat, lon, 42164160 - own * cos(gc) * cos(radians(lon - ({lon0}))) as ahead, -own * cos(gc) * sin(radians(lon - ({lon0}))) as west, own * sin(gc) as north
  from (select lat, lon, gc, 6356752.31414 / sqrt(1 - (1 - pow(6356752.31414 / 6378137, 2)) * cos(gc) * cos(gc)) as own from (select lat, lon, atan(pow(6356752.31414 / 6378137, 2) * tan(radians(lat))) as gc from g)))
  where 42164160 * (42164160 - ahead) >= west * west + pow(6378137 / 6356752.31414, 2) * north * north"""


def _pulled(view: str, side: int) -> str:
    return f"""select lat, lon, sum(w * value) / sum(w) as value from (
  select lat, lon, cast(floor(r) as bigint) + i as row, cast(floor(c) as bigint) + j as col, (case when i = 1 then r - floor(r) else 1 - r + floor(r) end) * (case when j = 1 then c - floor(c) else 1 - c + floor(c) end) as w
  from ({view}), range(0, 2) a(i), range(0, 2) b(j) where r > -1 and c > -1 and r < 40 and c < 70) join raster using (row, col) where side = {side} and w > 0 group by lat, lon"""


@query(f""", raster as ({_RASTER}), g as (select cast(24 + i * 0.5 as double) as lat, cast(-125 + j * 0.5 as double) as lon from range(0, 53) x(i), range(0, 119) y(j)),
e as ({_pulled(_view(-0.105, -75), 0)}), w as ({_pulled(_view(-0.03, -137), 1)})
select coalesce(e.lat, w.lat) as lat, coalesce(e.lon, w.lon) as lon, round(coalesce(e.value, w.value), 4) as value, case when e.value is null then 1 else 0 end as layer from e full join w on e.lat = w.lat and e.lon = w.lon""", "zones")
def satellite_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    """Two satellites' rasters on one grid of latitudes and longitudes; the eastern one where both see."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    raster = lines.groupBy((F.col("l_linenumber") % 2).alias("side"), (F.col("l_orderkey") % 40).cast("long").alias("row"), (F.col("l_partkey") % 70).cast("long").alias("col")).agg(F.round(F.avg("l_quantity"), 4).alias("value"))
    steps = lambda first, n: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: first + i * 0.5))
    targets = spark.range(1).select(steps(24.0, 53).alias("lat")).select("lat", steps(-125.0, 119).alias("lon"))
    layers = []
    for side, (view, grid) in enumerate(((EAST, EAST_GRID), (WEST, WEST_GRID))):
        seen = targets.withColumn("at", view.xy(F.col("lat"), F.col("lon"))).where("at is not null")
        layers.append(resample(seen, raster.where(F.col("side") == side).drop("side"), grid, F.col("at.x"), F.col("at.y"), ["lat", "lon"], []))
    return mosaic(layers, ["lat", "lon"]).select("lat", "lon", F.round("value", 4).alias("value"), "layer")


_CONE = "(6371229 * cos(radians(38.5)) * pow(tan(pi() / 4 + radians(38.5) / 2), sin(radians(38.5))) / sin(radians(38.5)))"
_RHO = f"{_CONE} / pow(tan(pi() / 4 + radians(lat) / 2), sin(radians(38.5)))"
_BASE = f"{_CONE} / pow(tan(pi() / 4 + radians(38.5) / 2), sin(radians(38.5)))"


@query(f""", raster as (select cast(l_orderkey % 60 as bigint) as row, cast(l_partkey % 90 as bigint) as col, max(l_quantity) as value from lineitem group by 1, 2),
p as (select station_id, cast(round_even(({_BASE} - {_RHO} * cos(sin(radians(38.5)) * radians(lon + 97.5)) + 1600000) / 55000, 0) as bigint) as row, cast(round_even(({_RHO} * sin(sin(radians(38.5)) * radians(lon + 97.5)) + 2400000) / 54000, 0) as bigint) as col from airports)
select station_id, p.row, p.col, value from p left join raster r on p.row = r.row and p.col = r.col where p.row between 0 and 59 and p.col between 0 and 89""", "airports")
def airport_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """The model's value at each airport: the nearest pixel of a Lambert grid; airports off the grid go."""
    raster = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy((F.col("l_orderkey") % 60).cast("long").alias("row"), (F.col("l_partkey") % 90).cast("long").alias("col")).agg(F.max("l_quantity").alias("value"))
    airports = role(spark, sf, "airports").select("station_id", Lambert().xy(F.col("lat"), F.col("lon")).alias("at"))
    found = nearest_pixel(airports, Grid(-2_400_000, -1_600_000, 54_000, 55_000, 60, 90), F.col("at.x"), F.col("at.y"))
    return found.join(raster, ["row", "col"], "left").select("station_id", "row", "col", "value")


#: Lines of orders as bins of the radars at the suppliers' places.
_BINS = [
    "cast(l_suppkey as bigint) as radar", "cast((l_orderkey * 7 + l_linenumber) % 360 as double) as azimuth",
    "cast(0.5 + l_linenumber % 3 * 0.5 as double) as beam", "cast(l_partkey % 230 as bigint) as bin", "cast(l_quantity as bigint) as value",
]


@query(f""", bin as (select b.*, s.lat, s.lon, (b.bin + 0.5) as km from (select {', '.join(_BINS)} from lineitem) b join sites s on s.site_id = b.radar where b.value > 1),
beam as (select *, cast(greatest(2, least(8, floor(beam / 0.25) + 2)) as bigint) as n from bin where km <= 230),
sample as (select radar, value, lat, lon, km, radians(azimuth + beam * i / (n - 1)) as a from beam, range(0, 8) x(i) where i < n),
place as (select radar, value, lat + km * cos(a) / 111.32 as y, lon + km * sin(a) / (111.32 * cos(radians(lat))) + 125 as x from sample),
cell as (select cast(floor((50 - y) / 0.25) as bigint) as row, cast(floor((x - 360 * floor(x / 360)) / 0.25) as bigint) as col, radar, value from place where y between 24 and 50 and x - 360 * floor(x / 360) < 59)
select row, col, max(value) as value, count(distinct radar) as radars from cell group by row, col""", "sites")
def radar_composite(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest echo of all radars on a grid of quarter degrees."""
    bins = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(*_BINS)
    sites = role(spark, sf, "sites").select(F.col("site_id").alias("radar"), "lat", "lon")
    return composite(bins.join(sites, "radar"), Canvas(-125, 24, -66, 50, 0.25), bin_km=1.0)


#: A raster of 40 x 70 nodes, made of orders' lines, for map tiles.
_NODES = "select cast(l_orderkey % 40 as bigint) as row, cast(l_partkey % 70 as bigint) as col, max(l_quantity) as value from lineitem group by 1, 2"
TILED, TILE_ZOOM, TILE_SIDE = Grid(-124.8, 49.7, 0.83, -0.63, 40, 70), 4, 64
_PIXELS = f"""raster as ({_NODES}),
edge as (select cast(y as bigint) as y, degrees(atan((exp(pi() * (1 - 2 * y / 16.0)) - exp(-pi() * (1 - 2 * y / 16.0))) / 2)) as lat from range(0, 17) t(y)),
cols as (select cast(px as bigint) as px, cast(round_even(((px + 0.5) / 1024.0 * 360 - 180 + 124.8) / 0.83, 0) as bigint) as col from range(0, 1024) t(px)),
rows as (select a.y * 64 + j as py, cast(round_even((49.7 - (a.lat - (j + 0.5) / 64.0 * (a.lat - b.lat))) / 0.63, 0) as bigint) as row from edge a join edge b on b.y = a.y + 1, range(0, 64) t(j)),
pixels as (select px, py, value from raster join cols using (col) join rows using (row))"""


def _sampled(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    raster = lines.groupBy((F.col("l_orderkey") % 40).cast("long").alias("row"), (F.col("l_partkey") % 70).cast("long").alias("col")).agg(F.max("l_quantity").alias("value"))
    return tiles.samples(raster, TILED, TILE_ZOOM, side=TILE_SIDE)


@query(f", {_PIXELS} select px // 64 as x, py // 64 as y, px % 64 as i, py % 64 as j, value, cast(floor(least(greatest((value - 5) / 40.0, 0), 1) * 4095) as int) as shade from pixels", "zones")
def tile_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of map tiles by nearest nodes, with their entries in a table of colours."""
    place = [F.floor(F.col(p) / TILE_SIDE).cast("long").alias(t) for p, t in (("px", "x"), ("py", "y"))]
    inside = [(F.col(p) % TILE_SIDE).alias(t) for p, t in (("px", "i"), ("py", "j"))]
    return _sampled(spark, sf).select(*place, *inside, "value", tiles.shade(F.col("value"), 5, 45).alias("shade"))


@query(f", {_PIXELS} select z as zoom, px // pow(2, 4 - z)::bigint as px, py // pow(2, 4 - z)::bigint as py, count(*) as known, round(avg(value), 6) as mean, max(value) as top from pixels, (select unnest([1, 2, 3, 4])::int as z) group by 1, 2, 3 having count(*) >= pow(4, 4 - z) / 2", "zones")
def tile_overviews(spark: SparkSession, sf: str) -> DataFrame:
    """A pyramid of overviews over the tiles' pixels; pixels of which less than half is known have none. The SQL takes every zoom from the pixels directly."""
    return tiles.overviews(_sampled(spark, sf), TILE_ZOOM, 1, share=0.5).withColumn("mean", F.round("mean", 6))
