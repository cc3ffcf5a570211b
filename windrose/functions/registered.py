"""SQL functions of a session: two scalar ones, and three tables by station over views ``model_winds`` and ``taf_winds``.

They are SQL themselves and are inlined into the plan. The time is an argument, never the clock.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SCALARS = (
    """create or replace temporary function calculate_flight_category(ceiling double, visibility double) returns string return
    case when ceiling < 500 or visibility < 1 then 'LIFR' when ceiling < 1000 or visibility < 3 then 'IFR' when ceiling <= 3000 or visibility <= 5 then 'MVFR' else 'VFR' end""",
    """create or replace temporary function calculate_wind_category(speed double, gust double) returns string return
    case when coalesce(gust, speed) >= 25 then 'EXTREME' when coalesce(gust, speed) >= 15 then 'CAUTION' when coalesce(gust, speed) is not null then 'NORMAL' end""",
)
_SOME = "valid_time timestamp_ntz, wind_dir int, wind_speed_kts double, wind_gust_kts double, wind_category string"
TABLES = (
    f"""create or replace temporary function get_current_model_winds(station string, hours int) returns table ({_SOME}, forecast_hour int) return
    select valid_time, wind_dir, wind_speed_kts, wind_gust_kts, wind_category, forecast_hour from
    (select *, max(model_run) over (partition by station_id) as newest from model_winds where station_id = get_current_model_winds.station)
    where model_run = newest and forecast_hour <= get_current_model_winds.hours""",
    """create or replace temporary function get_current_taf_winds(station string, as_of timestamp_ntz)
    returns table (valid_from timestamp_ntz, valid_to timestamp_ntz, wind_dir int, wind_speed_kts double, wind_gust_kts double, wind_category string, change_indicator string) return
    select valid_from, valid_to, wind_dir, wind_speed_kts, wind_gust_kts, wind_category, change_indicator from
    (select *, max(taf_issue_time) over (partition by station_id) as newest from taf_winds where station_id = get_current_taf_winds.station)
    where taf_issue_time = newest and valid_to >= get_current_taf_winds.as_of""",
    """create or replace temporary function get_max_forecast_winds(station string, as_of timestamp_ntz, hours int)
    returns table (max_wind_kts double, max_gust_kts double, max_wind_time timestamp_ntz, wind_category string) return
    select max(wind_speed_kts), max(wind_gust_kts), max_by(valid_time, wind_speed_kts), calculate_wind_category(max(wind_speed_kts), max(wind_gust_kts)) from
    (select *, max(model_run) over (partition by station_id) as newest from model_winds where station_id = get_max_forecast_winds.station)
    where model_run = newest and valid_time between get_max_forecast_winds.as_of and get_max_forecast_winds.as_of + make_dt_interval(0, get_max_forecast_winds.hours)""",
)


def register(spark: SparkSession, tables: bool = True) -> None:
    """All functions; without ``tables`` the scalar ones, which need no views."""
    for text in SCALARS + (TABLES if tables else ()):
        spark.sql(text)
