"""Streams of events equal the batch fold over the same reports, in any order of arrival and across restarts; ends pass by timers."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from windrose.operators import merge
from windrose.streaming import lifecycle

SCHEMA = "key string, issued timestamp, number long, action string, ends timestamp, zones array<string>"
START = dt.datetime(2024, 5, 1)


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def reports():
    rng, rows = random.Random(4), []
    for k in range(12):
        for i in range(rng.randrange(1, 7)):
            issued = START + dt.timedelta(minutes=rng.randrange(0, 300, 10))  # ties of one time
            ends = None if rng.random() < 0.3 else issued + dt.timedelta(hours=rng.randrange(1, 9))
            rows.append((f"e{k}", issued, 100 * k + i, rng.choice(["NEW", "CON", "EXT", "COR", "CAN", "EXP", "UPG"]), ends, rng.choice([None, ["Z1"], ["Z2", None, "Z3"], []])))
    return rows


def run(spark, folder, late):
    """Everything that has landed goes through; all rows so far."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    keep = lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
    lifecycle.event_lives(stream, late).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect()


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def last(rows):
    out = {}
    for r in rows:
        if r.key not in out or r.version > out[r.key].version:
            out[r.key] = r
    return out


def test_equals_the_batch_over_shuffled_arrival_and_a_restart(spark, tmp_path):
    rows = reports()
    want = merge.event_states(spark.createDataFrame(rows, SCHEMA).withColumn("zones", F.coalesce("zones", F.array().cast("array<string>"))), ["key"], ["issued", "number"])
    want = {r.key: (r.active, r.ends, [z for z in r.zones if z is not None], r.last_action) for r in want.collect()}
    shuffled = random.Random(1).sample(rows, len(rows))
    folder = str(tmp_path)
    for part, cut in enumerate((slice(0, 9), slice(9, 20))):
        land(spark, folder, shuffled[cut])
    first = run(spark, folder, "3000 days")
    land(spark, folder, shuffled[20:])
    found = run(spark, folder, "3000 days")  # a new query over the old checkpoint
    assert len(found) > len(first)
    got = {k: (r.active, r.ends, r.zones, r.last_action) for k, r in last(found).items()}
    assert got == want and max(r.version for r in found) > 1


def test_ends_pass_and_corrections_revive(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    folder = str(tmp_path)
    land(spark, folder, [("a", at(0), 1, "NEW", at(3), ["Z"]), ("b", at(0), 2, "NEW", at(20), None)])
    land(spark, folder, [("clock", at(6), 3, "CON", None, None)])
    rows = last(run(spark, folder, "2 hours"))
    assert (rows["a"].active, rows["a"].expired, rows["b"].active) == (False, True, True)
    land(spark, folder, [("a", at(5), 4, "EXT", at(12), ["Y"])])  # issued before the newest report, within the delay
    rows = last(run(spark, folder, "2 hours"))
    assert (rows["a"].active, rows["a"].ends, rows["a"].zones, rows["a"].last_action) == (True, at(12), ["Y", "Z"], "EXT")
    land(spark, folder, [("clock", at(30), 5, "CON", None, None)])
    rows = last(run(spark, folder, "2 hours"))
    assert (rows["a"].active, rows["b"].active) == (False, False)


def test_live_periods(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [("east", at(m)) for m in (0, 3, 12, 40, 41, 200)] + [("west", at(5)), ("west", at(200))]
    spark.createDataFrame(rows, "feed string, at timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("feed string, at timestamp").parquet(f"{tmp_path}/in")
    lifecycle.live_periods(stream, "feed", "at").writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("live").collect())) == [("east", at(0), at(22), 3), ("east", at(40), at(51), 2), ("west", at(5), at(15), 1)]
