"""Files that land are read once each, newest first, over restarts, replays and equal times."""

from __future__ import annotations

import os
import random
import time

from windrose.sources import landing


def land(folder, feed, name, age):
    os.makedirs(f"{folder}/{feed}", exist_ok=True)
    path = f"{folder}/{feed}/{name}"
    with open(path, "w") as out:
        out.write(name)
    at = time.time() - age
    os.utime(path, ns=(int(at) * 10**9, int(at) * 10**9))


def names(rows):
    return [r[1].rsplit("/", 1)[1] for r in rows]


def test_newest_first_until_the_backlog_is_gone(tmp_path):
    folder = str(tmp_path)
    base = 1000
    for i in range(9):
        land(folder, "a", f"f{i}", base - 10 * (i // 2))  # pairs of equal times
    land(folder, "b", "only", 500)
    reader, at, seen = landing.LandingReader(folder, 2, 30, None), {"feeds": {}}, []
    rows, at = reader.read(at)
    first = names(rows)
    assert set(first) == {"f8", "f7", "only"} and first.index("f8") < first.index("f7")
    seen += first
    land(folder, "a", "late", 100)  # newer than all
    land(folder, "a", "fresh", 0)  # too young
    while True:
        before, (rows, at) = at, reader.read(at)
        got = names(rows)
        assert sorted(names(reader.readBetweenOffsets(before, at))) == sorted(got)
        if not got:
            break
        seen += got
    assert sorted(seen) == sorted([f"f{i}" for i in range(9)] + ["late", "only"]) and len(at["feeds"]["a"]) == 1
    assert names(landing.LandingReader(folder, 9, 0, 50).read(at)[0]) == ["fresh"]


def test_random_arrivals_lose_and_repeat_nothing(tmp_path):
    folder, rng, seen, at = str(tmp_path), random.Random(3), [], {"feeds": {}}
    reader = landing.LandingReader(folder, 3, 5, None)
    for step in range(40):
        for k in range(rng.randrange(0, 5)):
            land(folder, rng.choice("ab"), f"s{step:02d}-{k}", 5000 - 10 * step)
        rows, at = reader.read(at)
        seen += names(rows)
    while rows := names((out := reader.read(at))[0]):
        seen, at = seen + rows, out[1]
    every = [n for _, _, files in os.walk(folder) for n in files]
    assert sorted(seen) == sorted(every) and all(len(s) == 1 for s in at["feeds"].values())


def test_stream_over_restarts(spark, tmp_path):
    spark.dataSource.register(landing.Landing)
    for i in range(5):
        land(f"{tmp_path}/in", "a", f"f{i}", 1000 - i)

    def run():
        stream = spark.readStream.format("landing").option("limit", 3).load(f"{tmp_path}/in")
        keep = lambda df, batch: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch}")
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted(os.path.basename(r.path) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert set(run()) >= {"f2", "f3", "f4"}
    land(f"{tmp_path}/in", "a", "g", 500)
    for _ in range(2):
        got = run()
    assert got == ["f0", "f1", "f2", "f3", "f4", "g"]
