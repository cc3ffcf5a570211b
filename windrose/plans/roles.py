"""Role views: weather tables that the driver's tables can play, by expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _place(id: str) -> list[str]:
    return [
        f"24 + cast({id} * 7919 % 2600 as double) / cast(100 as double) as lat",
        f"-125 + cast({id} * 104729 % 5900 as double) / cast(100 as double) as lon",
    ]


_K = "cast(regexp_extract(props, '[0-9]+', 0) as int)"
ROLES: dict[str, tuple[str, list[str]]] = {
    "airports": ("customer", ["c_custkey as station_id", *_place("c_custkey"), "cast(1500 + c_custkey * 37 % 10500 as int) as runway_ft", "c_custkey % 11 = 0 as military", "c_nationkey as region"]),
    "metar": ("events", [
        "event_id as obs_id", "user_id as station_id", "ts as seen_at", "cast(floor(value) as int) % 45 as speed",
        f"nullif({_K} % 50, 0) as gust", f"cast({_K} - 40 as double) as temp_c", f"cast({_K} - 40 - event_id % 10 as double) as dew_c",
        "event_id * 37 % 36 * 10 as direction", "nullif(event_id * 53 % 70, 0) * 100 as ceiling", "cast(event_id * 29 % 25 as double) / cast(2 as double) as visibility",
        "event_type = 'error' as special",
    ]),
    "winds": ("lineitem", ["l_partkey as station_id", "l_orderkey as run_id", "l_shipdate as valid_at", "l_linenumber as hour", "l_quantity as speed", "round(l_quantity * (1 + l_discount), 6) as gust"]),
    "flashes": ("events", ["event_id as flash_id", "ts as seen_at", *_place("event_id"), "value as energy", "event_id % 5 as quality", "event_id % 2 as side"]),
    "sites": ("supplier", ["s_suppkey as site_id", *_place("s_suppkey"), "s_nationkey as wing"]),
    "runways": ("part", ["p_partkey % 100 as station_id", "p_partkey as runway_id", "p_size * 7 % 360 as heading"]),
    "overrides": ("orders", [
        "o_custkey as station_id",
        "case o_orderkey % 12 when 0 then 'wind_y' when 1 then 'wind_r' when 2 then 'cross_y' when 3 then 'cross_r' when 4 then 'cross_ifr_y' when 5 then 'cross_ifr_r' when 6 then 'ceiling_y' when 7 then 'ceiling_r' when 8 then 'visibility_y' when 9 then 'visibility_r' when 10 then 'cold_y' else 'cold_r' end as parameter",
        "cast(case when o_orderkey % 12 in (6, 7) then 1000 + o_orderkey % 7 * 300 when o_orderkey % 12 in (8, 9) then o_orderkey % 5 when o_orderkey % 12 >= 10 then o_orderkey % 31 else 5 + o_orderkey % 20 end as double) as threshold",
    ]),
    "zones": ("nation", ["n_nationkey as zone_id", "n_regionkey as region_id", "n_name as name"]),
    "limits": ("nation", ["n_nationkey as limit_id", "case when n_nationkey % 2 = 0 then n_nationkey else 100 + n_regionkey end as owner", "case when n_nationkey % 3 = 0 then 'wind' when n_nationkey % 3 = 1 then 'ceiling' else 'visibility' end as parameter", "cast(n_nationkey * 3 as double) as threshold"]),
}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = ROLES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def sql(query: str, *names: str) -> str:
    """A query with the role views that it names."""
    views = [f"{n} as (select {', '.join(ROLES[n][1])} from {ROLES[n][0]})" for n in names]
    joint = "" if query.startswith(",") else " "
    return f"with {', '.join(views)}{joint}{query}"
