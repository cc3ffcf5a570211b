"""Named queries on warnings and polygons anywhere on the globe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.polygons import meeting, points_in
from ..operators.warnings import active_warnings, reported
from .weather import QUERIES, SQL, Query


def registered(f: Query) -> Query:
    """A query whose SQL stands by itself below it."""
    QUERIES[f.__name__] = f
    return f


#: Events as products: what each reports, in terms that Spark and DuckDB both read.
_N = "cast(regexp_extract(props, '[0-9]+', 0) as int)"
_PRODUCT = {
    "product": "event_id", "issued": "date_trunc('minute', ts)", "k": _N, "number": "cast(user_id % 400 as int)",
    "phenomenon": "case cast(user_id % 4 as int) when 0 then 'TO' when 1 then 'SV' when 2 then 'FF' else 'WS' end",
    "significance": "case when user_id % 3 = 0 then 'A' when user_id % 3 = 1 then 'W' else 'Y' end",
    "action": "case event_type when 'view' then 'NEW' when 'click' then 'CON' when 'signup' then 'EXT' when 'purchase' then 'CAN' else 'UPG' end",
    "lat": "3000 + user_id * 37 % 1500", "lon": "8000 + user_id * 53 % 4000",
}
_COLUMNS = ", ".join(f"{text} as {name}" for name, text in _PRODUCT.items())
_SHAPED = "(significance = 'W' and action <> 'CON')"
AS_OF = "timestamp '2024-01-20 12:00:00'"


def _written(products: DataFrame) -> DataFrame:
    """Products as they come over the wire."""
    stamp = lambda t: F.date_format(t, "yyMMdd'T'HHmm'Z'")
    ends = F.when(F.col("k") % 5 == 0, "000000T0000Z").otherwise(stamp(F.col("issued") + F.make_dt_interval(F.lit(0), F.col("k"))))
    code = F.format_string("/O.%s.KAAA.%s.%s.%04d.%s-%s/", "action", "phenomenon", "significance", "number", stamp(F.col("issued")), ends)
    corner = lambda y, x: F.format_string("%d %d", F.col("lat") + y, F.col("lon") + x)
    ring = F.concat_ws(" ", F.lit("LAT...LON"), corner(0, 0), corner(0, -100), corner(100, -100), corner(100, 0))
    motion = F.format_string("TIME...MOT...LOC %sZ %03dDEG %dKT %d %d", F.date_format("issued", "HHmm"), F.col("k") * 3, F.col("k") + 1, "lat", "lon")
    body = F.concat_ws("\n", F.concat(F.lit("WWUS53 KAAA "), F.date_format("issued", "ddHHmm")), F.format_string("XXZ%03d-%03d>%03d-%s-", F.col("k") % 30, 40 + F.col("k") % 4, 42 + F.col("k") % 4, F.date_format("issued", "ddHHmm")), code, F.when(F.expr(_SHAPED), ring), F.when(F.col("k") % 2 == 0, motion), F.lit("$$"))
    return products.select("product", "issued", body.alias("text"))


def _zones(spark: SparkSession, sf: str) -> DataFrame:
    zone = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("n"))
    corner = lambda x, y: F.struct((F.col("n") * 2.0 - 120 + x).alias("lon"), (F.lit(30.0) + F.col("n") % 5 + y).alias("lat"))
    return zone.select(F.format_string("XXZ%03d", "n").alias("zone"), F.array(F.array(corner(0.0, 0.0), corner(1.5, 0.0), corner(1.5, 1.0), corner(0.0, 1.0), corner(0.0, 0.0))).alias("rings"))


#: The fold of each event, from the columns that the products were written from.
_FOLD = f"""with product as (select *, case when k % 5 = 0 then null else issued + to_hours(k) end as ends, {_SHAPED} as shaped from (select {_COLUMNS} from events)),
known as (select * from product where issued <= {AS_OF}),
event as (select phenomenon, significance, number, max_by(action, (issued, product)) as last_action, max_by(ends, (issued, product)) filter (where ends is not null) as ends, min(issued) as begins,
  min_by(lat, (issued, product)) filter (where shaped) as lat, min_by(lon, (issued, product)) filter (where shaped) as lon, max_by(k, (issued, product)) filter (where k % 2 = 0) as moved from known group by all),
now as (select * from event where last_action <> 'CAN' and (ends is null or ends > {AS_OF})),
code as (select distinct phenomenon, significance, number, z from (select *, unnest([k % 30, 40 + k % 4, 41 + k % 4, 42 + k % 4]) as z from known)),
named as (select phenomenon, significance, number, string_agg('XXZ' || lpad(cast(z as varchar), 3, '0'), ',' order by z) as zones, count(*) filter (where z in (select n_nationkey from nation)) as n_zones from code group by all)"""


@registered
def active_warning_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Warnings that are active at a time, from their texts: zones, where the shape comes from, how many rings it has, motion and rank."""
    products = spark.read.parquet(f"{sf}/events.parquet").selectExpr(*[f"{text} as {name}" for name, text in _PRODUCT.items()])
    found = active_warnings(reported(_written(products)), _zones(spark, sf), F.expr(AS_OF.replace("timestamp", "timestamp_ntz")))
    first = F.element_at(F.element_at("rings", 1), 1)
    return found.select(
        "phenomenon", "significance", "number", "begins", "ends", F.array_join("zones", ",").alias("zones"), "from_zones", F.size("rings").cast("long").alias("n_rings"),
        F.when(~F.col("from_zones"), F.round(first["lat"], 2)).alias("lat"), F.when(~F.col("from_zones"), F.round(first["lon"], 2)).alias("lon"),
        F.col("motion.degrees").alias("degrees"), F.col("motion.knots").alias("knots"), "last_action", "rank",
    )


SQL["active_warning_shapes"] = f"""{_FOLD}
select now.phenomenon, now.significance, now.number, begins, ends, zones, lat is null as from_zones, case when lat is null then n_zones else 1 end as n_rings, round(lat / 100.0, 2) as lat, round(-lon / 100.0, 2) as lon,
  moved * 3 as degrees, moved + 1 as knots, last_action, cast(case significance when 'W' then 10 when 'A' then 20 else 30 end + case phenomenon when 'TO' then 1 when 'SV' then 2 when 'FF' then 4 else 6 end as int) as rank
from now join named using (phenomenon, significance, number) where lat is not null or n_zones > 0"""

#: Places, none on a border, and star-shaped zones with holes on both sides of the antimeridian; longitudes run on beyond 180 in SQL.
_AROUND = ["event_id as p_id", "cast(event_id * 7919 % 5000 as double) / cast(100 as double) - 10.00123 as p_lat", "cast(event_id * 104729 % 6000 as double) / cast(100 as double) + 150.00457 as lon"]
_CORNERS = [(0.0, 6.0), (1.5, 2.0), (6.0, 1.8), (2.4, -1.0), (3.9, -5.5), (0.0, -2.5), (-3.9, -5.5), (-2.4, -1.0), (-6.0, 1.8), (-1.5, 2.0), (0.0, 6.0)]
_HOLE = [(0.0, 1.2), (0.9, -0.7), (-0.9, -0.7), (0.0, 1.2)]


def _stars(spark: SparkSession, sf: str) -> DataFrame:
    zone = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("g_id"))
    x, y = 155.0 + F.col("g_id") * 2.13, -5.0 + (F.col("g_id") * 7 % 25) * 1.57
    corner = lambda dx, dy: F.struct((F.pmod(x + dx + 180, F.lit(360.0)) - 180).alias("lon"), (y + dy).alias("lat"))
    return zone.select("g_id", F.array(*[F.array(*[corner(*c) for c in ring]) for ring in (_CORNERS, _HOLE)]).alias("rings"))


_EDGES = " union all ".join(f"select g, x + {a[0]} as ax, y + {a[1]} as ay, x + {b[0]} as ux, y + {b[1]} as uy from star" for ring in (_CORNERS, _HOLE) for a, b in zip(ring, ring[1:]))
_STAR = f"star as (select n_nationkey as g, 155.0 + n_nationkey * 2.13 as x, -5.0 + (n_nationkey * 7 % 25) * 1.57 as y from nation), edge as (select g, cast(ax as double) as ax, cast(ay as double) as ay, cast(ux as double) as ux, cast(uy as double) as uy from ({_EDGES}))"


@registered
def places_in_zones_around_the_globe(spark: SparkSession, sf: str) -> DataFrame:
    """Which zone holds which place, on both sides of the antimeridian; zones have holes."""
    places = spark.read.parquet(f"{sf}/events.parquet").selectExpr(*_AROUND).select("p_id", "p_lat", (F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180).alias("p_lon"))
    return points_in(places, _stars(spark, sf)).select("p_id", "g_id")


SQL["places_in_zones_around_the_globe"] = f"""with {_STAR}, place as (select {', '.join(_AROUND)} from events)
select p_id, g as g_id from place, edge where (ay > p_lat) <> (uy > p_lat) and lon < ax + (p_lat - ay) * (ux - ax) / (uy - ay) group by p_id, g having count(*) % 2 = 1"""


@registered
def zones_that_meet(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different zones that share a place."""
    stars = _stars(spark, sf)
    return meeting(stars, stars).where(F.col("left") < F.col("right")).select(F.col("left").alias("zone"), F.col("right").alias("other"))


_SIDE = "(({e}.ux - {e}.ax) * ({y} - {e}.ay) - ({e}.uy - {e}.ay) * ({x} - {e}.ax))"
_APART = lambda e, f: f"{_SIDE.format(e=e, x=f'{f}.ax', y=f'{f}.ay')} * {_SIDE.format(e=e, x=f'{f}.ux', y=f'{f}.uy')} < 0"
SQL["zones_that_meet"] = f"""with {_STAR},
crossing as (select a.g as zone, b.g as other from edge a join edge b on a.g < b.g and {_APART('a', 'b')} and {_APART('b', 'a')}),
corner as (select p.g as g, e.g as h from edge p join edge e on p.g <> e.g and (e.ay > p.ay) <> (e.uy > p.ay) and p.ax < e.ax + (p.ay - e.ay) * (e.ux - e.ax) / (e.uy - e.ay) group by p.g, p.ax, p.ay, e.g having count(*) % 2 = 1)
select zone, other from crossing union select least(g, h), greatest(g, h) from corner"""
