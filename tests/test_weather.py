"""Every weather query equals its SQL; operators on hand-written edge cases."""

from __future__ import annotations

import pytest

import windrose.plans.more  # registers its queries
import windrose.plans.sites  # registers its queries
from oracle import compare
from pyspark.sql import functions as F

from windrose.functions import classify, geo
from windrose.operators import latest, merge, spatial
from windrose.plans import weather
from windrose.sources import readers
from windrose.streaming import alerts


@pytest.mark.parametrize("name", list(weather.queries()))
def test_equals_sql(spark, sf_dir, name):
    compare(weather.queries()[name](spark, sf_dir), weather.oracle_sql()[name], sf_dir)


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flight_category_limits(spark):
    df = spark.createDataFrame([(0, 10.0), (3000, 10.0), (None, None), (5000, 5.0)], "c int, v double")
    got = df.select(classify.flight_category(F.col("c"), F.col("v")), classify.flight_category_strict(F.col("c"), F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("LIFR", "LIFR"), ("MVFR", "VFR"), ("VFR", "UNKNOWN"), ("MVFR", "VFR")]


def test_box_wraps_and_rejects(spark):
    df = spark.createDataFrame([(0.0, 179.0), (0.0, -179.0), (0.0, 0.0)], "lat double, lon double")
    assert df.where(geo.in_box(F.col("lat"), F.col("lon"), -209, -5, -170, 5)).count() == 2
    with pytest.raises(ValueError):
        geo.in_box(F.col("lat"), F.col("lon"), 0, 5, 1, 5)


def test_radius_crosses_the_antimeridian(spark):
    points = spark.createDataFrame([(1, 0.0, 179.9), (2, 0.0, -179.9), (3, 0.0, 10.0)], "p_id long, p_lat double, p_lon double")
    sites = spark.createDataFrame([(1, 0.0, 180.0)], "s_id long, s_lat double, s_lon double")
    assert sorted(r.p_id for r in spatial.within_radius(points, sites, 10).collect()) == [1, 2]


def test_merges_with_nulls_and_empty(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, merge.upsert(old, new, ["k"]).collect()), key=str) == [(1, "a"), (2, None), (3, "c")]
    assert merge.upsert(old.limit(0), new.limit(0), ["k"]).count() == 0
    assert merge.insert_absent(old, new, ["k"]).count() == 3


def test_runs_of_one_and_gaps(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 5)], "k string, i int")
    assert sorted(tuple(r) for r in latest.runs(df, ["k"], "i").collect()) == [("a", 1, 2, 2), ("a", 5, 5, 1)]


def test_bulletins_and_log(spark, tmp_path):
    (tmp_path / "a.txt").write_text("METAR KDCA 061452Z\n 27015G25KT=\nKIAD 061452Z VRB05KT=\n")
    assert sorted(r.report for r in readers.bulletins(spark, str(tmp_path)).collect()) == ["KIAD 061452Z VRB05KT", "METAR KDCA 061452Z 27015G25KT"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x.log").write_text('1.2.3.4 - - [01/Jan/2024:00:00:00 +0000] "GET / HTTP/1.1" 200 5\nbroken\n')
    assert [(r.ip, r.status) for r in readers.access_log(spark, str(tmp_path / "log")).collect()] == [("1.2.3.4", 200)]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("at"), "event_type")
    rows.unionByName(rows.limit(50)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    counted = alerts.exactly_once(stream, ["event_id"], "at")
    q = counted.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == rows.count()


def test_label_priority(spark):
    rows = [("Base", 3000, True), (None, 12000, False), ("", 12000, False), ("Dover Afb", 0, False), ("Lake International", 3000, False), ("Long", 10000, False), ("Mid", 5000, None), ("Mid", 4999, False), ("Mid", None, False)]
    df = spark.createDataFrame(rows, "n string, r int, m boolean")
    assert [x[0] for x in df.select(classify.label_priority(F.col("n"), F.col("r"), F.col("m"))).collect()] == [1, 4, 4, 1, 2, 2, 3, 4, 4]
