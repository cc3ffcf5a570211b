"""Active warnings from hand-written products, and parsers of zones, motion and times at their limits."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from windrose.functions import reports
from windrose.operators import warnings

AT = dt.datetime(2024, 5, 6, 12, 0)


def product(action, kind, number, ugc, ends="240506T1800Z", extra="", sign="W"):
    return f"WUUS53 KIND 061100\n{ugc}\n/O.{action}.KIND.{kind}.{sign}.{number:04d}.240506T1100Z-{ends}/\ntext\n{extra}\n$$\n"


def rows(spark):
    ring = "LAT...LON 3950 8600 3950 8550 4000 8550 4000 8600\nTIME...MOT...LOC 1100Z 245DEG 35KT 3960 8590"
    over = "LAT...LON 5000 17950 5000 -17950 5100 -17950 5100 17950"
    texts = [
        (1, 60, product("NEW", "SV", 1, "INZ001-003-061800-", extra=ring)), (2, 30, product("CON", "SV", 1, "INZ005>007-061800-", extra="STORM_MOTION: 250DEG 40KT LOC 39.7,-85.8")),
        (3, 60, product("NEW", "TO", 2, "INZ001-061800-", sign="A")), (4, 50, product("NEW", "TO", 3, "INZ099-061800-")), (5, 50, product("NEW", "FF", 4, "INZ001-061800-", extra=ring)), (6, 40, product("CAN", "FF", 4, "INZ001-061800-")),
        (7, 50, product("NEW", "FL", 5, "INZ001-061800-", "240506T1130Z", ring)), (8, 50, product("NEW", "FL", 6, "INZ001-061800-", "000000T0000Z", ring)), (9, -10, product("NEW", "SV", 7, "INZ001-061800-", extra=ring)), (10, 20, None), (11, 20, product("NEW", "WS", 8, "AKZ001-061800-", extra=over.replace("-17950", "18050"))),
    ]
    df = spark.createDataFrame([(p, AT - dt.timedelta(minutes=m), t) for p, m, t in texts], "product int, issued timestamp_ntz, text string")
    return warnings.reported(df)


def zones(spark):
    ring = "array(named_struct('lon', -86.0D, 'lat', 39D), named_struct('lon', -85.0D, 'lat', 39D), named_struct('lon', -85.0D, 'lat', 40D), named_struct('lon', -86.0D, 'lat', 39D))"
    return spark.sql(f"select 'INZ001' as zone, array({ring}) as rings")


def found(spark, box=None):
    return {(r.phenomenon, r.number): r for r in warnings.active_warnings(rows(spark), zones(spark), F.lit(AT), box).collect()}


def test_states_shapes_motion_and_order(spark):
    got = found(spark)
    assert set(got) == {("SV", 1), ("TO", 2), ("FL", 6), ("WS", 8)}  # unknown zone, cancelled, past its end and not yet issued are out
    storm, watch = got["SV", 1], got["TO", 2]
    assert storm.zones == ["INZ001", "INZ003", "INZ005", "INZ006", "INZ007"] and not storm.from_zones and len(storm.rings[0]) == 5
    assert tuple(storm.motion) == (250, 40, 39.7, -85.8) and storm.last_action == "CON" and storm.ends == dt.datetime(2024, 5, 6, 18)
    assert watch.from_zones and len(watch.rings) == 1 and watch.motion is None and got["FL", 6].ends is None
    assert sorted(got.values(), key=lambda r: r["rank"])[0] is storm and max(got.values(), key=lambda r: r["rank"]) is watch


@pytest.mark.parametrize("box,want", [((-87, 38, -84, 41), {("SV", 1), ("TO", 2), ("FL", 6)}), ((170, 40, -170, 60), {("WS", 8)}), ((0, 0, 10, 10), set()), ((-180, -80, 180, 80), {("SV", 1), ("TO", 2), ("FL", 6), ("WS", 8)})])
def test_boxes(spark, box, want):
    assert set(found(spark, box)) == want


def test_broken_box(spark):
    with pytest.raises(ValueError):
        found(spark, (0, 5, 1, 5))


def test_zones_and_motion(spark):
    one = lambda e, t: spark.createDataFrame([(t,)], "t string").select(e(F.col("t"))).first()[0]
    assert one(reports.zones, "INZ001>004-KYC010-012-130100-") == ["INZ001", "INZ002", "INZ003", "INZ004", "KYC010", "KYC012"]
    assert one(reports.zones, "INZ007>005-130100-") == ["INZ007"] and one(reports.zones, None) is None
    assert tuple(one(reports.storm_track, "TIME...MOT...LOC 0239Z 265DEG 39KT 3856 9653")) == pytest.approx((265, 39, 38.56, -96.53))
    assert tuple(one(reports.storm_track, "STORM_MOTION: 5DEG 7KT")) == (5, 7, None, None) and one(reports.storm_track, "none") is None


@pytest.mark.parametrize("day,year,month,received,want", [
    ("310051", 2024, 2, None, dt.datetime(2024, 1, 31, 0, 51)), ("312351", 2024, 1, None, dt.datetime(2024, 1, 31, 23, 51)), ("300000", 2024, 1, dt.datetime(2024, 1, 1, 1), dt.datetime(2023, 12, 30)), ("311200", 2023, 1, dt.datetime(2023, 1, 1), dt.datetime(2022, 12, 31, 12)), ("990000", 2024, 1, None, None),
])
def test_report_of_the_month_before(spark, day, year, month, received, want):
    df = spark.createDataFrame([(f"KDCA {day}Z 27015KT 10SM 20/10 A2992", received)], "t string, r timestamp_ntz")
    got = df.select(reports.metar(F.col("t"), F.lit(year), F.lit(month), None if received is None else F.col("r")).alias("m")).first().m
    assert got.observation_time == want and got.temp_c == 20
