"""Cooldown as the query's SQL counts it: from the report before, sent or not."""

from __future__ import annotations

import datetime

from oracle import compare

from windrose.plans import more, weather  # noqa: F401


def test_chains_repeats_and_missing_times_equal_the_sql(spark, tmp_path):
    at = lambda m: None if m is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    found = [(1, 0), (1, 10), (1, 20), (1, 34.9), (1, 50), (2, 5), (2, 5), (2, 20), (None, 0), (None, 14), (None, 28), (3, None), (3, None), (3, 1)]
    rows = [(i, at(m), u, "error", 1.0, '{"k": 1}') for i, (u, m) in enumerate(found)] + [(99, at(40), 1, "view", 1.0, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "events.parquet").write_bytes(next((tmp_path / "t").glob("*.parquet")).read_bytes())
    compare(weather.queries()["alert_cooldown"](spark, str(tmp_path)), weather.oracle_sql()["alert_cooldown"], str(tmp_path))
