"""Named weather queries over role views of the driver's tables, each with the SQL it must equal.

The time of evaluation is the newest observation of the table; ties are broken by ids.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, geo, physics
from ..operators import latest, merge, spatial
from .roles import role, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(text: str, *names: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql(text, *names)
        return f

    return keep


def recent(spark: SparkSession, sf: str, days: int = 2, as_of: datetime | None = None) -> DataFrame:
    """Observations of the days before ``as_of``, which goes to the scan as a constant; without it, before the newest."""
    metar = role(spark, sf, "metar")
    if as_of is not None:
        return metar.where(F.col("seen_at").between(F.lit(as_of - timedelta(days=days)), F.lit(as_of))).withColumn("now", F.lit(as_of))
    return metar.crossJoin(F.broadcast(metar.agg(F.max("seen_at").alias("now")))).where(F.col("seen_at") >= F.col("now") - F.expr(f"interval {days} days"))


_RECENT = "recent as (select m.*, x.now from metar m, (select max(seen_at) as now from metar) x where seen_at >= now - interval 2 days)"
_LAST = "last as (select * from (select *, row_number() over (partition by station_id order by seen_at desc, obs_id desc) rn from recent) where rn = 1)"


@query(f", {_RECENT}, {_LAST} select l.station_id, obs_id, speed, gust, case when region = 0 or runway_ft >= 8000 then 'large' when runway_ft >= 5000 then 'medium' else 'small' end as size from last l left join airports a on l.station_id = a.station_id where lat between 25 and 45 and lon between -120 and -75", "metar", "airports")
def recent_obs_in_bbox(spark: SparkSession, sf: str, as_of: datetime | None = None) -> DataFrame:
    last = latest.latest_per_key(recent(spark, sf, as_of=as_of).drop("now"), ["station_id"], "seen_at", ["obs_id"])
    out = last.join(role(spark, sf, "airports"), "station_id", "left").where(geo.in_box(F.col("lat"), F.col("lon"), -120, 25, -75, 45))
    return out.select("station_id", "obs_id", "speed", "gust", classify.size_class(F.col("runway_ft"), F.col("region") == 0).alias("size"))


_PRIORITY = "case when military then 1 when region = 0 then 2 when runway_ft >= 5000 then 3 when runway_ft >= 2500 then 4 else 5 end"


@query(f", {_RECENT}, {_LAST} select l.station_id, obs_id, speed, {_PRIORITY} as priority from last l join airports a on l.station_id = a.station_id where lat between 20 and 60 and (lon >= 151 or lon <= -80) order by priority, speed desc nulls last, l.station_id limit 100", "metar", "airports")
def prioritised_obs_antimeridian(spark: SparkSession, sf: str, as_of: datetime | None = None) -> DataFrame:
    last = latest.latest_per_key(recent(spark, sf, as_of=as_of).drop("now"), ["station_id"], "seen_at", ["obs_id"])
    out = last.join(role(spark, sf, "airports"), "station_id").where(geo.in_box(F.col("lat"), F.col("lon"), -209, 20, -80, 60))
    out = out.select("station_id", "obs_id", "speed", classify.station_priority(F.col("military"), F.col("runway_ft"), F.col("region")).alias("priority"))
    return out.orderBy("priority", F.desc_nulls_last("speed"), "station_id").limit(100)


@query(f", {_RECENT} select station_id, runway_ft from airports a where not exists (select 1 from recent r where r.station_id = a.station_id)", "metar", "airports")
def airports_without_recent_obs(spark: SparkSession, sf: str, as_of: datetime | None = None) -> DataFrame:
    return role(spark, sf, "airports").join(recent(spark, sf, as_of=as_of), "station_id", "left_anti").select("station_id", "runway_ft")


@query(f", {_RECENT} select station_id, runway_ft from airports a where exists (select 1 from recent r where r.station_id = a.station_id and special)", "metar", "airports")
def airports_with_special_obs(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "airports").join(recent(spark, sf).where("special"), "station_id", "left_semi").select("station_id", "runway_ft")


@query(f", {_RECENT} select station_id, obs_id, rn from (select *, row_number() over (partition by station_id order by seen_at desc, obs_id desc) rn from recent) where rn <= 6", "metar")
def station_history(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("station_id").orderBy(F.desc("seen_at"), F.desc("obs_id"))
    return recent(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 6").select("station_id", "obs_id", "rn")


@query("select station_id, region, min(speed) as low, max(speed) as high, max(gust) as gust, count(*) as n, case when max(gust) >= 25 then 'EXTREME' when max(gust) >= 15 then 'CAUTION' else 'NORMAL' end as category from winds join airports using (station_id) where hour <= 4 group by station_id, region", "winds", "airports")
def worst_wind_by_station(spark: SparkSession, sf: str) -> DataFrame:
    out = role(spark, sf, "winds").where("hour <= 4").groupBy("station_id").agg(F.min("speed").alias("low"), F.max("speed").alias("high"), F.max("gust").alias("gust"), F.count("*").alias("n"))
    out = out.join(role(spark, sf, "airports").select("station_id", "region"), "station_id")
    return out.withColumn("category", classify.wind_category(F.col("high"), F.col("gust")))


@query("select run_id, count(distinct hour) as hours, count(distinct hour) >= 4 as complete from winds group by run_id", "winds")
def run_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "winds").groupBy("run_id").agg(F.countDistinct("hour").alias("hours")).withColumn("complete", F.col("hours") >= 4)


@query("select run_id, max(hour) as last_hour from winds group by run_id having max(hour) >= 7 order by run_id desc limit 1", "winds")
def latest_complete_run(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "winds").groupBy("run_id").agg(F.max("hour").alias("last_hour")).where("last_hour >= 7").orderBy(F.desc("run_id")).limit(1)


@query("select station_id, valid_at, speed from (select *, row_number() over (partition by station_id order by speed desc, valid_at) rn from winds) where rn = 1", "winds")
def max_wind_time(spark: SparkSession, sf: str) -> DataFrame:
    return latest.top_per_key(role(spark, sf, "winds"), ["station_id"], [F.desc("speed"), F.col("valid_at")]).select("station_id", "valid_at", "speed")


@query("select station_id, hour, run_id, speed from (select *, row_number() over (partition by station_id, hour order by nullif(run_id % 4, 3) asc nulls last, run_id desc, speed desc, valid_at desc) rn from winds) where rn = 1", "winds")
def best_source_per_airport_hour(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.asc_nulls_last(F.expr("nullif(run_id % 4, 3)")), F.desc("run_id"), F.desc("speed"), F.desc("valid_at")]
    return latest.top_per_key(role(spark, sf, "winds"), ["station_id", "hour"], order).select("station_id", "hour", "run_id", "speed")


@query("select site_id, max(case when parameter = 'wind' then threshold end) as wind, max(case when parameter = 'ceiling' then threshold end) as ceiling, max(case when parameter = 'visibility' then threshold end) as visibility from sites left join limits on owner = wing or owner = 100 + wing % 5 group by site_id", "sites", "limits")
def limits_pivot_or_join(spark: SparkSession, sf: str) -> DataFrame:
    """A join by either of two keys as one equi-join over both."""
    sites = role(spark, sf, "sites").select("site_id", F.explode(F.array_distinct(F.array("wing", 100 + F.col("wing") % 5))).alias("owner"))
    out = sites.join(role(spark, sf, "limits"), "owner", "left").groupBy("site_id").pivot("parameter", ["wind", "ceiling", "visibility"]).agg(F.max("threshold"))
    return out


@query("select obs_id, case when ceiling < 500 or visibility < 1 then 'LIFR' when ceiling < 1000 or visibility < 3 then 'IFR' when ceiling <= 3000 or visibility <= 5 then 'MVFR' else 'VFR' end as included, case when visibility is null then 'UNKNOWN' when ceiling < 500 or visibility < 1 then 'LIFR' when ceiling < 1000 or visibility < 3 then 'IFR' when ceiling < 3000 or visibility < 5 then 'MVFR' else 'VFR' end as excluded from metar", "metar")
def flight_categories(spark: SparkSession, sf: str) -> DataFrame:
    c, v = F.col("ceiling"), F.col("visibility")
    return role(spark, sf, "metar").select("obs_id", classify.flight_category(c, v).alias("included"), classify.flight_category_strict(c, v).alias("excluded"))


@query("""select obs_id, case when speed > 25 or gust > 35 then 'R' when speed >= 15 or gust >= 25 then 'Y' else 'G' end as wind,
 case when temp_c * 9.0 / 5.0 + 32.0 <= 90 then 'G' when temp_c * 9.0 / 5.0 + 32.0 <= 103 then 'Y' else 'R' end as heat,
 case when temp_c * 9.0 / 5.0 + 32.0 >= 21 then 'G' when temp_c * 9.0 / 5.0 + 32.0 >= 0 then 'Y' else 'R' end as cold,
 case when temp_c < 25.6 then 'WHITE' when temp_c < 27.8 then 'GREEN' when temp_c < 29.4 then 'YELLOW' when temp_c < 31.1 then 'RED' else 'BLACK' end as flag,
 case when gust is null then 'UNKNOWN' when gust <= 9.0 then 'G' when gust <= 55.4 then 'Y' else 'R' end as air,
 case when gust >= 60 then 'red' when gust >= 20 then 'yellow' when gust is null then null else 'green' end as thunder,
 case when greatest(speed, coalesce(gust, speed)) >= 30 then 'NO-GO' when greatest(speed, coalesce(gust, speed)) >= 16 then 'CAUTION' else 'NORMAL' end as model from metar""", "metar")
def stoplights(spark: SparkSession, sf: str) -> DataFrame:
    f, speed, gust = physics.fahrenheit(F.col("temp_c")), F.col("speed"), F.col("gust")
    return role(spark, sf, "metar").select(
        "obs_id", classify.surface_wind(speed, gust).alias("wind"), classify.heat_stress(f).alias("heat"), classify.cold_stress(f).alias("cold"),
        classify.wbgt_flag(F.col("temp_c")).alias("flag"), classify.pm25(gust).alias("air"), classify.thunder(gust).alias("thunder"),
        classify.model_wind_category(speed, gust).alias("model"),
    )


@query("""select obs_id, case when wind = 'R' or sky = 'R' then 'R' when wind = 'Y' or sky = 'Y' then 'Y' else 'G' end as colour,
 case when sky = 'G' and wind = 'G' then null when (wind = 'R') or (wind = 'Y' and sky <> 'R') then 'wind' else 'ceiling' end as reason from
 (select obs_id, case when speed > 30 then 'R' when speed > 21 then 'Y' else 'G' end as wind, case when coalesce(ceiling, 99999) < 1000 then 'R' when coalesce(ceiling, 99999) <= 2000 then 'Y' else 'G' end as sky from metar)""", "metar")
def go_nogo_colors(spark: SparkSession, sf: str) -> DataFrame:
    """Worst colour and its first cause; a missing ceiling is unlimited."""
    sky = F.coalesce("ceiling", F.lit(99999))
    m = role(spark, sf, "metar").select("obs_id", F.when(F.col("speed") > 30, "R").when(F.col("speed") > 21, "Y").otherwise("G").alias("wind"), F.when(sky < 1000, "R").when(sky <= 2000, "Y").otherwise("G").alias("sky"))
    colour = classify.worst(F.col("wind"), F.col("sky"))
    return m.select("obs_id", colour.alias("colour"), F.when(colour == "G", None).when(F.col("wind") == colour, "wind").otherwise("ceiling").alias("reason"))


#: National limits that an airport's own may replace; 0 is no limit of its own.
_LIMITS = {"wind_y": 21, "wind_r": 30, "cross_y": 8, "cross_r": 15, "cross_ifr_y": 8, "cross_ifr_r": 13, "ceiling_y": 2000, "ceiling_r": 1000, "visibility_y": 3, "visibility_r": 1, "cold_y": 20, "cold_r": -10}
_OWN = ", ".join(f"max(case when parameter = '{k}' then nullif(threshold, 0) end) as {k}" for k in _LIMITS)
_WITH_LIMITS = ", ".join(f"coalesce({k}, {v}) as {k}" for k, v in _LIMITS.items())
_OVER = "case when {0} is null then 'UNKNOWN' when {0} > {2} then 'R' when {0} > {1} then 'Y' else 'G' end"
_UNDER = "case when {0} < {2} then 'R' when {0} <= {1} then 'Y' else 'G' end"
_VFR = {
    "wind": _OVER.format("speed", "wind_y", "wind_r"), "crosswind": _OVER.format("xw", "cross_y", "cross_r"), "ceiling": _UNDER.format("ceiling", "ceiling_y", "ceiling_r"),
    "visibility": _UNDER.format("visibility", "visibility_y", "visibility_r"), "temp_cold": f"case when t is null then 'UNKNOWN' else {_UNDER.format('t', 'cold_y', 'cold_r')} end",
    "temp_hot": "case when t is null then 'UNKNOWN' when t > 104 then 'R' when t >= 90 then 'Y' else 'G' end", "wind_chill": _UNDER.format("chill", "22", "0"),
}
_IFR = {"wind": _VFR["wind"], "crosswind": _OVER.format("xw", "cross_ifr_y", "cross_ifr_r"), "ceiling": _UNDER.format("ceiling", "800", "500"), "visibility": _UNDER.format("visibility", "1", "0.5")}


def _worst_sql(rule: dict[str, str], name: str) -> str:
    """The worst colour and the first parameter that has it."""
    any_of = lambda c: " or ".join(f"({v}) = '{c}'" for v in rule.values())
    first = lambda c: "case " + " ".join(f"when ({v}) = '{c}' then '{k}'" for k, v in rule.items()) + " end"
    return f"case when {any_of('R')} then 'R' when {any_of('Y')} then 'Y' else 'G' end as {name}, case when {any_of('R')} then {first('R')} else {first('Y')} end as {name}_reason"


@query(f""", own as (select station_id as s, {_OWN} from overrides group by station_id),
 c as (select obs_id as o, min(round(abs(m.speed * sin(radians(m.direction - r.heading))), 1)) as xw from metar m join runways r on m.station_id = r.station_id group by obs_id),
 j as (select obs_id, speed, ceiling, visibility, temp_c * 9.0 / 5.0 + 32.0 as t, cast(speed as double) * 1.15078 as mph, xw, {_WITH_LIMITS} from metar left join own on station_id = s left join c on obs_id = o),
 k as (select *, case when t <= 50 and mph >= 3 then round(35.74 + 0.6215 * t - 35.75 * pow(mph, 0.16) + 0.4275 * t * pow(mph, 0.16), 6) end as chill from j)
 select obs_id, {_worst_sql(_VFR, 'vfr')}, {_worst_sql(_IFR, 'ifr')} from k""", "metar", "runways", "overrides")
def go_nogo_all_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Worst VFR and IFR colour and its first cause over all parameters, with the runway of least crosswind and the airport's own limits."""
    m = role(spark, sf, "metar")
    both = m.join(role(spark, sf, "runways"), "station_id")
    cross = both.groupBy("obs_id").agg(F.min(physics.crosswind(F.col("speed"), F.col("direction"), F.col("heading"))).alias("xw"))
    own = role(spark, sf, "overrides").groupBy("station_id").pivot("parameter", list(_LIMITS)).agg(F.max(F.nullif("threshold", F.lit(0.0))))
    own = own.select("station_id", *_LIMITS)
    return go_nogo(m.join(own, "station_id", "left").join(cross, "obs_id", "left"))


def go_nogo(rows: DataFrame) -> DataFrame:
    """Colours of observations with ``xw``, the least crosswind, and their airports' limits; a missing ceiling or visibility is unlimited, what is unknown loses to any colour."""
    t = physics.fahrenheit(F.col("temp_c"))
    mph = F.col("speed").cast("double") * 1.15078
    rows = rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in _LIMITS.items()} | {"t": t, "chill": F.when((t <= 50) & (mph >= 3), physics.wind_chill_f(t, mph))})
    out = ["obs_id"]
    for name, rule in (("vfr", _VFR), ("ifr", _IFR)):
        colours = [F.expr(v) for v in rule.values()]
        worst = classify.worst(*colours)
        cause = F.coalesce(*[F.when(c == worst, F.lit(k)) for k, c in zip(rule, colours)])
        out += [worst.alias(name), F.when(worst != "G", cause).alias(f"{name}_reason")]
    return rows.select(*out)


@query("""select obs_id, case when t <= 50 and mph >= 3 then round(35.74 + 0.6215 * t - 35.75 * pow(mph, 0.16) + 0.4275 * t * pow(mph, 0.16), 6) else round(t, 6) end as chill,
 case when t >= 80 and hi > t then round(hi, 4) else round(t, 4) end as heat from (select *, -42.379 + 2.04901523 * t + 10.14333127 * rh - 0.22475541 * t * rh - 0.00683783 * t * t - 0.05481717 * rh * rh + 0.00122874 * t * t * rh + 0.00085282 * t * rh * rh - 0.00000199 * t * t * rh * rh as hi from
 (select *, greatest(0.0, least(100.0, 100.0 - (t - d) * 25.0 / 9.0)) as rh from (select obs_id, temp_c * 9.0 / 5.0 + 32.0 as t, dew_c * 9.0 / 5.0 + 32.0 as d, cast(speed as double) * 1.15078 as mph from metar)))""", "metar")
def apparent_temperatures(spark: SparkSession, sf: str) -> DataFrame:
    t, d = physics.fahrenheit(F.col("temp_c")), physics.fahrenheit(F.col("dew_c"))
    return role(spark, sf, "metar").select("obs_id", physics.wind_chill_f(t, F.col("speed").cast("double") * 1.15078).alias("chill"), physics.heat_index_f(t, d).alias("heat"))


@query("""select obs_id, runway_id, crosswind, headwind from (select *, row_number() over (partition by obs_id order by crosswind, headwind desc, runway_id) rn from
 (select obs_id, runway_id, round(abs(speed * sin(radians(direction - heading))), 1) + 0.0 as crosswind, round(speed * cos(radians(direction - heading)), 1) + 0.0 as headwind from metar join runways using (station_id))) where rn = 1""", "metar", "runways")
def runway_components_best(spark: SparkSession, sf: str) -> DataFrame:
    both = role(spark, sf, "metar").join(role(spark, sf, "runways"), "station_id")
    c = [F.col(x) for x in ("speed", "direction", "heading")]
    both = both.select("obs_id", "runway_id", physics.crosswind(*c).alias("crosswind"), physics.headwind(*c).alias("headwind"))
    return latest.top_per_key(both, ["obs_id"], [F.col("crosswind"), F.desc("headwind"), F.col("runway_id")])


_NM = "round(2.0 * 3440.065 * asin(least(1.0, sqrt(pow(sin(radians(a.lat - s.lat) / 2.0), 2) + cos(radians(s.lat)) * cos(radians(a.lat)) * pow(sin(radians(a.lon - s.lon) / 2.0), 2)))), 6)"


def _points(df: DataFrame, id: str, to: str = "p") -> DataFrame:
    return df.select(F.col(id).alias(f"{to}_id"), F.col("lat").alias(f"{to}_lat"), F.col("lon").alias(f"{to}_lon"))


@query(f"select site_id, station_id, nm from (select s.site_id, a.station_id, {_NM} as nm from airports a, sites s) where nm <= 100", "airports", "sites")
def stations_within_radius(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spatial.within_radius(_points(role(spark, sf, "airports"), "station_id"), _points(role(spark, sf, "sites"), "site_id", "s"), 100)
    return pairs.select(F.col("s_id").alias("site_id"), F.col("p_id").alias("station_id"), "nm")


@query(f"select site_id, station_id, nm from (select *, row_number() over (partition by site_id order by nm, station_id) rn from (select s.site_id, a.station_id, {_NM} as nm from airports a, sites s)) where rn <= 5", "airports", "sites")
def knn_stations(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spatial.nearest(_points(role(spark, sf, "airports"), "station_id"), _points(role(spark, sf, "sites"), "site_id", "s"), 5, 300)
    return pairs.select(F.col("s_id").alias("site_id"), F.col("p_id").alias("station_id"), "nm")


@query(f"select site_id, count(*) as n, min(nm) as nearest_nm, max(seen_at) as last_at, count(*) filter (where nm <= 10) > 0 as warning from (select s.site_id, a.seen_at, {_NM} as nm from flashes a, sites s where quality = 0 and energy >= 10) where nm <= 30 group by site_id", "flashes", "sites")
def lightning_proximity(spark: SparkSession, sf: str) -> DataFrame:
    flashes = role(spark, sf, "flashes").where("quality = 0 and energy >= 10").select(F.col("flash_id").alias("p_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "seen_at")
    pairs = spatial.within_radius(flashes, _points(role(spark, sf, "sites"), "site_id", "s"), 30)
    return pairs.groupBy(F.col("s_id").alias("site_id")).agg(F.count("*").alias("n"), F.min("nm").alias("nearest_nm"), F.max("seen_at").alias("last_at"), (F.count_if(F.col("nm") <= 10) > 0).alias("warning"))


@query("select station_id, zone_id from airports a, zones z where lat >= 26 + zone_id % 5 * 4 and lat < 32 + zone_id % 5 * 4 and lon >= -120 + zone_id * 2 + (lat - (26 + zone_id % 5 * 4)) and lon < -112 + zone_id * 2 + (lat - (26 + zone_id % 5 * 4))", "airports", "zones")
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    """Slanted zones of four corners."""
    zone = role(spark, sf, "zones")
    y, x = (26 + F.col("zone_id") % 5 * 4).cast("double"), (-120 + F.col("zone_id") * 2).cast("double")
    corner = lambda dx, dy: F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))
    rings = zone.select(F.col("zone_id").alias("g_id"), F.array(corner(0, 0), corner(8, 0), corner(14, 6), corner(6, 6), corner(0, 0)).alias("ring"))
    return spatial.in_polygons(_points(role(spark, sf, "airports"), "station_id"), rings).select(F.col("p_id").alias("station_id"), F.col("g_id").alias("zone_id"))


@query("select obs_id, before from (select m.obs_id, special, (select p.obs_id from metar p where p.station_id = m.station_id and not p.special and p.seen_at < m.seen_at order by p.seen_at desc limit 1) as before from metar m) where special", "metar")
def preceding_report_asof(spark: SparkSession, sf: str) -> DataFrame:
    m = role(spark, sf, "metar")
    return m.withColumn("before", latest.preceding(m, ["station_id"], "seen_at", F.col("special"), "obs_id")).where("special").select("obs_id", "before")


@query("select coalesce(e.slot, w.slot) as slot, coalesce(e.energy, w.energy) as energy from (select time_bucket(interval 5 minutes, seen_at) as slot, max(energy) as energy from flashes where side = 0 group by 1) e full join (select time_bucket(interval 5 minutes, seen_at) as slot, max(energy) as energy from flashes where side = 1 group by 1) w on e.slot = w.slot", "flashes")
def two_source_bucket_merge(spark: SparkSession, sf: str) -> DataFrame:
    slots = role(spark, sf, "flashes").groupBy(F.window("seen_at", "5 minutes").getField("start").alias("slot")).agg(F.max(F.when(F.col("side") == 0, F.col("energy"))).alias("east"), F.max(F.when(F.col("side") == 1, F.col("energy"))).alias("west"))
    return slots.select("slot", F.coalesce("east", "west").alias("energy"))


@query("select station_id, first, last, n from (select station_id, min(hour) as first, max(hour) as last, count(*) as n from (select station_id, hour, hour - row_number() over (partition by station_id order by hour) as island from (select distinct station_id, hour from winds where speed >= 25)) group by station_id, island)", "winds")
def contiguous_runs(spark: SparkSession, sf: str) -> DataFrame:
    return latest.runs(role(spark, sf, "winds").where("speed >= 25"), ["station_id"], "hour")


@query("""select g.glat, g.glon, case when min(d) < 0.1 then round(cast(max(v) filter (where d < 0.1) as double), 4) else round(sum(v / pow(d, 2)) filter (where d >= 0.1) / sum(1 / pow(d, 2)) filter (where d >= 0.1), 4) end as value
 from (select cast(x.lat as double) as glat, cast(y.lon as double) as glon from (select unnest(range(26, 56, 4)) as lat) x, (select unnest(range(-120, -50, 5)) as lon) y) g
 left join (select *, sqrt(pow(60 * (lat - glat), 2) + pow(60 * (lon - glon) * cos(radians(glat)), 2)) as d from (select lat, lon, runway_ft as v from airports), (select cast(x.lat as double) as glat, cast(y.lon as double) as glon from (select unnest(range(26, 56, 4)) as lat) x, (select unnest(range(-120, -50, 5)) as lon) y)) n
 on n.glat = g.glat and n.glon = g.glon and d <= 240 group by g.glat, g.glon""", "airports")
def idw_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Inverse squared distances; nodes without a station in reach are null."""
    return spatial.idw(role(spark, sf, "airports").select("lat", "lon", F.col("runway_ft").alias("v")), (26, 54, 4), (-120, -55, 5))


_OLD = "o as (select station_id, hour, max(speed) as speed, min(gust) as gust from winds where run_id % 2 = 0 group by 1, 2), n as (select station_id, hour, max(speed) as speed, min(gust) as gust from winds where run_id % 2 = 1 group by 1, 2)"


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    w = role(spark, sf, "winds")
    return tuple(w.where(f"run_id % 2 = {k}").groupBy("station_id", "hour").agg(F.max("speed").alias("speed"), F.min("gust").alias("gust")) for k in (0, 1))


@query(f", {_OLD} select coalesce(n.station_id, o.station_id) as station_id, coalesce(n.hour, o.hour) as hour, coalesce(n.speed, o.speed) as speed, coalesce(n.gust, o.gust) as gust from o full join n on o.station_id = n.station_id and o.hour = n.hour", "winds")
def upsert_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    return merge.upsert(*_halves(spark, sf), ["station_id", "hour"])


@query(f", {_OLD} select coalesce(o.station_id, n.station_id) as station_id, coalesce(o.hour, n.hour) as hour, coalesce(o.speed, n.speed) as speed, coalesce(o.gust, n.gust) as gust from o full join n on o.station_id = n.station_id and o.hour = n.hour", "winds")
def upsert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return merge.insert_absent(*_halves(spark, sf), ["station_id", "hour"])


@query(f", {_OLD} select coalesce(o.station_id, n.station_id) as station_id, coalesce(o.hour, n.hour) as hour, greatest(o.speed, n.speed) as speed, coalesce(o.gust, n.gust) as gust from o full join n on o.station_id = n.station_id and o.hour = n.hour", "winds")
def upsert_conditional(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"speed": F.greatest("old.speed", "new.speed"), "gust": F.coalesce("old.gust", "new.gust")}
    return merge.upsert(*_halves(spark, sf), ["station_id", "hour"], rules)


@query("select station_id, array_to_string(list_sort(list_distinct(list(hour))), ',') as hours from winds group by station_id", "winds")
def upsert_merge_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "winds").groupBy("station_id").agg(F.array_join(F.array_sort(F.collect_set("hour")), ",").alias("hours"))


@query("select run_id, hour, station_id from (select *, row_number() over (partition by run_id, hour order by valid_at desc, station_id, speed, gust) rn from winds) where rn = 1", "winds")
def dedupe_keep_newest(spark: SparkSession, sf: str) -> DataFrame:
    return merge.newest(role(spark, sf, "winds"), ["run_id", "hour"], [F.desc("valid_at"), F.col("station_id"), F.col("speed"), F.col("gust")]).select("run_id", "hour", "station_id")


@query("select w.* from winds w where station_id in (select station_id from airports)", "winds", "airports")
def orphan_purge(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "winds").join(role(spark, sf, "airports"), "station_id", "left_semi").select("station_id", "run_id", "valid_at", "hour", "speed", "gust")


@query("select station_id, count(*) as n from winds w where not exists (select 1 from airports a where a.station_id = w.station_id) group by station_id", "winds", "airports")
def orphan_audit(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "winds").join(role(spark, sf, "airports"), "station_id", "left_anti").groupBy("station_id").agg(F.count("*").alias("n"))


@query("select station_id, count(*) as n from (select *, max(valid_at) over (partition by station_id) as last from winds) where valid_at >= last - interval 90 days group by station_id", "winds")
def retention_by_max(spark: SparkSession, sf: str) -> DataFrame:
    return merge.retain(role(spark, sf, "winds"), ["station_id"], "valid_at", "90 days").groupBy("station_id").agg(F.count("*").alias("n"))


_GROUP = "lpad(cast(direction as varchar), 3, '0') || lpad(cast(speed as varchar), 2, '0') || case when gust > speed then 'G' || lpad(cast(gust as varchar), 2, '0') else '' end || 'KT'"


@query(f"select obs_id, cast(regexp_extract(g, '([0-9]{{3}}|VRB)([0-9]{{2,3}})(G([0-9]{{2,3}}))?KT', 2) as int) as speed, try_cast(regexp_extract(g, '([0-9]{{3}}|VRB)([0-9]{{2,3}})(G([0-9]{{2,3}}))?KT', 4) as int) as gust from (select obs_id, {_GROUP} as g from metar)", "metar")
def taf_wind_groups(spark: SparkSession, sf: str) -> DataFrame:
    group = F.expr(_GROUP.replace("varchar", "string"))
    part = lambda i: F.regexp_extract(group, r"(\d{3}|VRB)(\d{2,3})(G(\d{2,3}))?KT", i)
    return role(spark, sf, "metar").select("obs_id", part(2).cast("int").alias("speed"), F.when(part(4) != "", part(4)).cast("int").alias("gust"))


@query("select latency, count(*) as n from (select case when speed < 10 then 'green' when speed < 15 then 'blue' when speed < 60 then 'yellow' else 'red' end as latency from metar) group by latency", "metar")
def radar_latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "metar").groupBy(classify.latency_colour(F.col("speed")).alias("latency")).agg(F.count("*").alias("n"))


@query("select station_id, case when max(seen_at) < (select max(seen_at) from metar) - interval 12 hours then 'STALE' else 'OK' end as state from metar group by station_id", "metar")
def freshness_status(spark: SparkSession, sf: str) -> DataFrame:
    m = role(spark, sf, "metar")
    last = m.groupBy("station_id").agg(F.max("seen_at").alias("last")).crossJoin(F.broadcast(m.agg(F.max("seen_at").alias("now"))))
    return last.select("station_id", F.when(F.col("last") < F.col("now") - F.expr("interval 12 hours"), "STALE").otherwise("OK").alias("state"))


@query("select event_type, user_id, n, pct from (select event_type, user_id, n, round(100.0 * n / sum(n) over (partition by event_type), 1) as pct, row_number() over (partition by event_type order by n desc, user_id) as rn from (select event_type, user_id, count(*) as n from events group by 1, 2)) where rn <= 3", "zones")
def top_n_per_group_pct(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    pct = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 1)
    return latest.top_per_key(n.withColumn("pct", pct), ["event_type"], [F.desc("n"), F.col("user_id")], 3)


@query("select station_id, min(seen_at) as alert_at, max(seen_at) + interval 15 minutes as clear_at, count(*) as n from (select *, sum(new) over (partition by station_id order by seen_at, obs_id) as session from (select *, case when seen_at - lag(seen_at) over (partition by station_id order by seen_at, obs_id) < interval 15 minutes then 0 else 1 end as new from metar where special)) group by station_id, session", "metar")
def all_clear(spark: SparkSession, sf: str) -> DataFrame:
    """The batch twin of the streaming alert sessions."""
    session = role(spark, sf, "metar").where("special").groupBy("station_id", F.session_window(F.col("seen_at").cast("timestamp"), "15 minutes").alias("w")).agg(F.count("*").alias("n"))
    return session.select("station_id", F.col("w.start").cast("timestamp_ntz").alias("alert_at"), F.col("w.end").cast("timestamp_ntz").alias("clear_at"), "n")


@query("select region, count(*) as n, count(distinct military) as kinds, min(lat) - 0.5 as south, max(lat) + 0.5 as north, min(lon) - 0.5 as west, max(lon) + 0.5 as east from airports group by region", "airports")
def region_extents(spark: SparkSession, sf: str) -> DataFrame:
    a = role(spark, sf, "airports").groupBy("region")
    return a.agg(F.count("*").alias("n"), F.countDistinct("military").alias("kinds"), (F.min("lat") - 0.5).alias("south"), (F.max("lat") + 0.5).alias("north"), (F.min("lon") - 0.5).alias("west"), (F.max("lon") + 0.5).alias("east"))


@query("select z.zone_id, count(station_id) as n from zones z join airports a on a.region = any(array[z.zone_id, (z.zone_id + 1) % 25]) group by z.zone_id", "zones", "airports")
def zone_array_join(spark: SparkSession, sf: str) -> DataFrame:
    zones = role(spark, sf, "zones").select("zone_id", F.explode(F.array("zone_id", ((F.col("zone_id") + 1) % 25).cast(role(spark, sf, "zones").schema["zone_id"].dataType))).alias("region"))
    return zones.join(role(spark, sf, "airports"), "region").groupBy("zone_id").agg(F.count("station_id").alias("n"))


@query("select m.obs_id, count(*) as n, max(w.speed) as top from metar m join winds w on w.station_id = m.station_id and w.hour between m.speed % 7 and m.speed % 7 + 1 where special group by m.obs_id", "metar", "winds")
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """Equal stations, hours within an interval."""
    m = role(spark, sf, "metar").where("special").select("obs_id", "station_id", (F.col("speed") % 7).alias("since"))
    w = role(spark, sf, "winds").select("station_id", "hour", F.col("speed").alias("top"))
    return m.join(w, "station_id").where(F.col("hour").between(F.col("since"), F.col("since") + 1)).groupBy("obs_id").agg(F.count("*").alias("n"), F.max("top").alias("top"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
