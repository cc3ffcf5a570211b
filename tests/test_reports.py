"""Decoded text, geometry, merges, alerts and SQL functions on hand-written cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from windrose.functions import classify, geo, physics, registered, reports
from windrose.operators import merge, spatial
from windrose.sources import readers
from windrose.streaming import alerts


def one(spark, column, **values):
    """The value of a column over one row of literals."""
    types = {str: "string", int: "int", float: "double", dt.datetime: "timestamp_ntz", bool: "boolean"}
    schema = ", ".join(f"{k} {types[type(v)] if v is not None else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def at(*x):
    return dt.datetime(*x)


def test_metar_fields(spark):
    decode = reports.metar(F.col("t"), F.lit(2024), F.lit(1))
    r = one(spark, decode, t="METAR KDCA 061452Z 27015G25KT 1 1/2SM -SN BR FEW008 BKN012 OVC030 M02/M05 A2992 RMK AO2 SLP100")
    assert (r.station_id, r.observation_time, r.temp_c, r.dewpoint_c, r.wind_dir, r.wind_speed_kts, r.wind_gust_kts) == ("KDCA", at(2024, 1, 6, 14, 52), -2.0, -5.0, 270, 15, 25)
    assert (r.visibility_sm, r.altimeter_hg, r.ceiling_ft, r.weather, r.is_speci) == (1.5, 29.92, 1200, ["-SN", "BR"], False)
    r = one(spark, decode, t="SPECI KIAD 310000Z VRB05KT 10SM BKN000 20/ A3001")
    assert (r.wind_dir, r.wind_speed_kts, r.ceiling_ft, r.dewpoint_c, r.is_speci, r.visibility_sm) == (None, 5, 0, None, True, 10.0)
    assert one(spark, decode, t="METAR KIAD 061452Z 27015KT 10SM A2992") is None and one(spark, decode, t=None) is None


def test_bulletins_and_precipitation(spark):
    text = "SAUS70 KWBC 061400\nKDCA 061452Z 27015KT 10SM\n  20/10 A2992=\nSPECI KIAD 061455Z VRB05KT 1SM 01/00\nMETAR KBWI 061454Z 00000KT 10SM 05/01="
    got = one(spark, reports.split_bulletin(F.col("t")), t=text)
    assert got == ["METAR KDCA 061452Z 27015KT 10SM 20/10 A2992", "SPECI KIAD 061455Z VRB05KT 1SM 01/00", "METAR KBWI 061454Z 00000KT 10SM 05/01"]
    for groups, kind in ((["-FZRA", "SN"], "fzra"), (["TSGR"], "hail"), (["-SG"], "snow"), (["RAPL"], "sleet"), (["+RA"], "rain"), (["BR"], None), ([], None)):
        assert one(spark, reports.precipitation_type(F.array(*map(F.lit, groups)).cast("array<string>")), t="") == kind


def test_taf(spark):
    text = "FTUS80 KWBC 301720\n123\nTAF AMD KDCA 301730Z 3018/3124 27015G25KT P6SM BKN040\n FM302200 VRB05KT P6SM\n TEMPO 3100/3104 18020G30KT 2SM\n PROB30 3106/3108 09010KT\n BECMG 3110/3112 CAVOK=\nTAF KIAD 301730Z 3018/3118 00000KT P6SM=\nTAF EGLL 301730Z 3018/3118 20010KT="
    tafs = one(spark, reports.split_tafs(F.col("t")), t=text)
    assert [x.split()[:3] for x in tafs] == [["TAF", "AMD", "KDCA"], ["TAF", "KIAD", "301730Z"]]
    p = one(spark, reports.taf_periods(F.col("t")), t=tafs[0])
    assert [(x.kind, x.span, x.probability, x.direction, x.speed, x.gust) for x in p] == [
        ("INITIAL", "3018/3124", None, 270, 15, 25), ("FM", "302200", None, None, 5, None), ("TEMPO", "3100/3104", None, 180, 20, 30), ("PROB", "3106/3108", 30, 90, 10, None),
    ]
    assert one(spark, reports.mentions(F.col("t"), F.lit("KDCA")), t=tafs[0]) and not one(spark, reports.mentions(F.col("t"), F.lit("KJFK")), t=tafs[0])
    v = one(spark, reports.valid_period(F.lit("3018/3124"), F.col("t")), t=at(2024, 1, 30, 17, 30))
    assert (v.start, v.end) == (at(2024, 1, 30, 18), at(2024, 2, 1, 0))
    v = one(spark, reports.valid_period(F.lit("3118/0124"), F.col("t")), t=at(2023, 12, 31, 17))
    assert (v.start, v.end) == (at(2023, 12, 31, 18), at(2024, 1, 2, 0))
    assert one(spark, reports.valid_period(F.lit("bad"), F.col("t")), t=at(2024, 1, 1)) is None


@pytest.mark.parametrize("text,want", [("311200", at(2023, 12, 31, 12)), ("011230", at(2024, 1, 1, 12, 30)), ("162400", at(2024, 1, 17)), ("181200", at(2023, 12, 18, 12)), ("991200", None)])
def test_day_time_rolls_back_a_month(spark, text, want):
    assert one(spark, reports.day_time(F.lit(text), F.col("t")), t=at(2024, 1, 2, 0)) == want


def test_warnings(spark):
    code = "/O.NEW.KIND.SV.W.0012.240601T1830Z-240601T1915Z/"
    text = f"WUUS53 KIND 011830\nINC001-003-KYC002-011915-\n{code}\nLAT...LON 3941 8430 3950 8420 3960 8440\nTIME...MOT...LOC 1830Z 245DEG 35KT 3945 8425\n$$\nINZ010-\n/O.UPG.KIND.WS.A.0003.000000T0000Z-240602T0000Z/\n/T.NEW.KIND.TO.A.0009.240601T1830Z-240601T1915Z/\n$$"
    events = one(spark, reports.events_of(F.col("t")), t=text)
    assert [(e.action, e.office, e.phenomenon, e.significance, e.number, e.begins, e.ends) for e in events] == [
        ("NEW", "KIND", "SV", "W", 12, at(2024, 6, 1, 18, 30), at(2024, 6, 1, 19, 15)), ("UPG", "KIND", "WS", "A", 3, None, at(2024, 6, 2)),
    ]
    assert len(one(spark, reports.events_of(F.col("t")), t=text + "\n" + text)) == 2
    assert one(spark, reports.zones(F.col("t")), t=text) == ["INC001", "INC003", "KYC002"] and one(spark, reports.zones(F.col("t")), t="none") == []
    ring = one(spark, reports.warning_ring(F.col("t")), t=text)
    assert [(p.lon, p.lat) for p in ring] == [(-84.3, 39.41), (-84.2, 39.5), (-84.4, 39.6), (-84.3, 39.41)]
    assert one(spark, reports.warning_ring(F.col("t")), t="LAT...LON 3941 8430") is None
    assert tuple(one(spark, reports.storm_motion(F.col("t")), t=text)) == (245, 35)
    assert [one(spark, classify.warning_colour(F.array(F.lit(c), F.lit("XX.X"))), t="") for c in ("TO.W", "WI.Y", "TO.Y")] == ["R", "Y", "G"]


def test_small_parsers(spark):
    assert one(spark, reports.granule_time(F.col("t")), t="OR_GLM-L2_G16_s20240601830205_e2.nc") == at(2024, 2, 29, 18, 30, 20)
    for text, status in (("VCP 212", "OPERATIONAL"), ("RADAR DOWN VCP 12", "FAILED"), ("DOWN for MAINT", "MAINTENANCE"), ("test", "TEST"), ("", "UNKNOWN"), ("back to normal", "OPERATIONAL")):
        assert one(spark, reports.radar_message(F.col("t")), t=text) == status
    assert one(spark, reports.identifier(F.lit("K-12"), F.lit(" KABC"), F.lit("X")), t="") == "KABC"
    assert [one(spark, reports.paved(F.lit(s)), t="") for s in ("ASPH-G", "CONC-TURF", "TURF", None)] == [True, False, False, False]
    assert one(spark, reports.military(F.lit("Scott AFB")), t="") and not one(spark, reports.military(F.lit("Nashville")), t="")
    assert one(spark, reports.phone(F.lit("+1 (937) 555-0100")), t="") == "9375550100" and one(spark, reports.phone(F.lit("555")), t="") is None
    assert [one(spark, reports.json_array(F.lit(x)), t="") for x in ('["a", "b"]', '{"a": 1}', None)] == [["a", "b"], [], []]
    p = one(spark, reports.place(F.lit("394142N0843046W")), t="")
    assert abs(p.lat - 39.695) < 1e-9 and abs(p.lon + 84.512777778) < 1e-6 and p.station is None
    assert one(spark, reports.place(F.lit("39.7, -84.5")), t="").lon == -84.5 and one(spark, reports.place(F.lit("kday")), t="").station == "KDAY"
    a = one(spark, reports.advisory(F.lit("AIRMET TANGO MOD TURB BLW FL180 BOUNDED BY N4530 W08400 N4400 W08330 N4300 W08500")), t="")
    assert (a.hazard, a.severity, len(a.ring), a.ring[0]) == ("TURB", "MODERATE", 4, a.ring[3])
    assert one(spark, reports.iso(F.lit(at(2024, 1, 2, 3, 4, 5))), t="") == "2024-01-02T03:04:05Z"


def test_geometry(spark):
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in p])
    triangle = ring((0, 0), (10, 0), (0, 10), (0, 0))
    for box, want in (((1, 1, 2, 2), True), ((-5, -5, 20, 20), True), ((6, 6, 8, 8), False), ((4, 4, 8, 8), True), ((-1, 3, 20, 4), True), ((20, 0, 30, 5), False)):
        assert one(spark, geo.ring_meets_box(triangle, *box), t="") == want
    circle = one(spark, geo.circle(F.lit(0.0), F.lit(10.0), 60.0), t="")
    assert len(circle) == 33 and circle[0] == circle[32] and abs(circle[0].lat - 1) < 1e-9 and abs(circle[8].lon - 11) < 1e-9
    assert tuple(one(spark, geo.tile(F.lit(40.0), F.lit(-75.0), 6), t="")) == (18, 24)
    corner = one(spark, geo.tile_corner(F.lit(18), F.lit(24), 6), t="")
    assert corner.lat > 40.0 and corner.lon <= -75.0 and tuple(one(spark, geo.tile(F.lit(corner.lat - 1e-6), F.lit(corner.lon + 1e-6), 6), t="")) == (18, 24)
    assert [one(spark, geo.ramp(F.lit(v), [(0, 10), (10, 20), (20, 0)]), t="") for v in (-1.0, 5.0, 15.0, 99.0)] == [10.0, 15.0, 10.0, 0.0]
    b = one(spark, geo.radar_bin(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(111.0)), t="")
    assert abs(b.lat) < 1e-9 and abs(b.lon - 1) < 1e-9
    assert one(spark, physics.wind_direction(F.lit(0.0), F.lit(-5.0)), t="") == 0.0 and one(spark, physics.dewpoint(F.lit(20.0), F.lit(100.0)), t="") == 20.0


def test_radius_over_the_pole_and_nearest_beyond_it(spark):
    points = spark.createDataFrame([(1, 89.95, 180.0), (2, 0.0, 0.0), (3, -60.0, 10.0)], "p_id long, p_lat double, p_lon double")
    sites = spark.createDataFrame([(1, 89.99, 0.0)], "s_id long, s_lat double, s_lon double")
    assert [r.p_id for r in spatial.within_radius(points, sites, 10).collect()] == [1]
    assert [r.p_id for r in spatial.nearest(points, sites, 2, 100).orderBy("nm").collect()] == [1, 2]
    assert spatial.nearest(points, sites, 5, 100).count() == 3


def test_idw_with_a_station_on_a_node(spark):
    points = spark.createDataFrame([(10.0, 20.0, 5), (10.0, 20.0, 9), (10.5, 20.0, 1)], "lat double, lon double, v int")
    got = {(r.glat, r.glon): r.value for r in spatial.idw(points, (10, 11, 1), (20, 40, 20), reach_nm=120).collect()}
    assert got[10.0, 20.0] == 9.0 and got[10.0, 40.0] is None and 1 < got[11.0, 20.0] < 9


def test_grid_samples(spark):
    grid = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(36)], "row long, col long, value double")
    points = spark.createDataFrame([(1, 0.5, 355.0), (2, 1.0, 20.0), (3, 25.0, 0.0)], "p_id long, p_lat double, p_lon double")
    got = {r.p_id: r.value for r in spatial.bilinear(points, grid, 0, 0, 10, columns=36).collect()}
    assert got[1] == 18.0 and got[2] == 3.0 and got[3] is None
    nodes = spark.createDataFrame([(7, 0.0, 0.0, 3.0), (8, 0.0, 1.0, 4.0)], "idx long, lat double, lon double, value double")
    near = {r.p_id: r.idx for r in spatial.nearest_node(spark.createDataFrame([(1, 0.05, 0.0), (2, 0.0, 0.5)], "p_id long, p_lat double, p_lon double"), nodes, 0.15).collect()}
    assert near == {1: 7, 2: None}


def test_merges_of_events(spark):
    old = spark.createDataFrame([("e", ["a", "b"], None, "one"), ("x", None, "g", "t")], "k string, zones array<string>, shape string, raw string")
    new = spark.createDataFrame([("e", ["c", "a"], "ring", "two")], "k string, zones array<string>, shape string, raw string")
    got = {r.k: (r.zones, r.shape, r.raw) for r in merge.merge_event(old, new, ["k"], ["zones"], ["shape"], ["raw"], " / ").collect()}
    assert got == {"e": (["a", "b", "c"], "ring", "one / two"), "x": (None, "g", "t")}
    rows = [("e", i, a, None, ["z"]) for i, a in enumerate(["NEW", "CON", "CAN"])] + [("f", 0, "UPG", None, ["y"]), ("g", 0, "NEW", None, []), ("g", 1, "EXP", None, ["q"])]
    states = merge.event_states(spark.createDataFrame(rows, "k string, at int, action string, ends timestamp_ntz, zones array<string>"), ["k"], ["at"])
    assert {r.k: (r.active, r.zones) for r in states.collect()} == {"e": (False, ["z"]), "f": (True, ["y"]), "g": (False, ["q"])}


MINUTES = [0, 10, 14, 16, 29, 31, 46, 47, 100]


def test_cooldown_in_chains_and_in_a_stream(spark, tmp_path):
    rows = [("s", "warn", at(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)) for m in MINUTES] + [("t", "warn", at(2024, 1, 1))]
    df = spark.createDataFrame(rows, "key string, type string, at timestamp")
    want = [0, 16, 31, 46, 100]
    got = sorted((r.at - at(2024, 1, 1)).seconds // 60 for r in merge.cooled(df.where("key = 's'"), ["key", "type"], "at").collect())
    assert got == want
    sent = []
    for part in (df.where("at < '2024-01-01 00:30:00'"), df.where("at >= '2024-01-01 00:30:00'")):  # the second run starts from the checkpoint
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = alerts.cooldown(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    sent = sorted((r.sent - at(2024, 1, 1)).seconds // 60 for r in spark.read.parquet(str(tmp_path / "out")).where("key = 's'").collect())
    assert sent == want


@pytest.mark.parametrize("minutes,due", [(14, False), (15, True), (30, True), (31, False)])
def test_all_clear_limits(spark, minutes, due):
    t = at(2024, 1, 1, 12, 0)
    sent = spark.createDataFrame([("s", t - dt.timedelta(minutes=minutes))], "key string, at timestamp_ntz")
    none = sent.limit(0)
    assert (alerts.all_clears(sent, none, F.lit(t)).count() == 1) == due
    assert alerts.all_clears(sent, spark.createDataFrame([("s", t)], "key string, at timestamp_ntz"), F.lit(t)).isEmpty()
    live = alerts.live_or_proxy(sent, sent.select("key", F.lit("G").alias("w")), F.lit(t), "w", "20 minutes").first().source
    assert live == ("feed" if minutes < 20 else "G")


def test_rolling_counts_and_sessions(spark, tmp_path):
    rows = [("s", at(2024, 1, 1, 0, m)) for m in (0, 4, 40)]
    spark.createDataFrame(rows, "key string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("rolled", alerts.rolling_counts(stream, "key", "at")), ("sessions", alerts.alert_sessions(stream, "key", "at"))):
        mode = "complete" if name == "rolled" else "append"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("rolled").agg(F.max("n")).first()[0] == 2 and spark.table("rolled").agg(F.sum("n")).first()[0] == 18
    assert [(r.n, r.clear_at - r.alert_at) for r in spark.table("sessions").collect()] in ([], [(2, dt.timedelta(minutes=19))])


def test_sql_functions(spark):
    t = at(2024, 1, 1)
    hour = dt.timedelta(hours=1)
    winds = [("K", t - 6 * hour, t, 0, 90.0, None), ("K", t, t + hour, 1, 10.0, 12.0), ("K", t, t + 5 * hour, 5, 20.0, 30.0), ("K", t, t + 30 * hour, 30, 50.0, None)]
    spark.createDataFrame([(s, r, v, h, 0, w, g, "N") for s, r, v, h, w, g in winds], "station_id string, model_run timestamp_ntz, valid_time timestamp_ntz, forecast_hour int, wind_dir int, wind_speed_kts double, wind_gust_kts double, wind_category string").createOrReplaceTempView("model_winds")
    spark.createDataFrame([("K", t, t - hour, t + hour, 0, 9.0, None, "N", "FM")], "station_id string, taf_issue_time timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, wind_dir int, wind_speed_kts double, wind_gust_kts double, wind_category string, change_indicator string").createOrReplaceTempView("taf_winds")
    registered.register(spark)
    assert tuple(spark.sql("select calculate_flight_category(3000, 10), calculate_flight_category(null, null), calculate_wind_category(10, 25), calculate_wind_category(null, null)").first()) == ("MVFR", "VFR", "EXTREME", None)
    assert spark.sql("select * from get_current_model_winds('K', 12)").count() == 2
    assert spark.sql("select * from get_current_taf_winds('K', timestamp_ntz'2024-01-01 00:30:00')").count() == 1
    assert tuple(spark.sql("select * from get_max_forecast_winds('K', timestamp_ntz'2024-01-01 00:00:00', 12)").first()) == (20.0, 30.0, t + 5 * hour, "EXTREME")


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("TAF KDCA 301730Z 3018/3118 27015KT=\nTAF EGLL 301730Z 3018/3118 20010KT=")
    (tmp_path / "b.txt").write_text("x" * 300)
    assert [r.report[:8] for r in readers.bulletins(spark, str(tmp_path), most=200, prefixes="KPTC").collect()] == ["TAF KDCA"]
    assert [r.bytes for r in readers.oversized(spark, str(tmp_path), 200).collect()] == [300]
    assert readers.newest_files(spark, str(tmp_path), 1).count() == 1
    rows = spark.createDataFrame([(1.0, 2.0, 9.9e36), (95.0, 2.0, 1.0), (3.0, 4.0, 5.0)], "lat double, lon double, e double")
    assert [r.e for r in readers.granules(rows, ["e"]).orderBy("lat").collect()] == [None, 5.0]
    assert readers.feature_collection(rows.limit(1)).first().feature.startswith('{"type":"Feature","geometry":{"type":"Point","coordinates":[2.0,1.0]}')
