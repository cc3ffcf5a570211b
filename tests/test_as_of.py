"""The time of evaluation as an argument: the same rows as from the newest, and a filter that the scan gets."""

from __future__ import annotations

import pytest

from windrose.plans import weather

NAMES = ["recent_obs_in_bbox", "prioritised_obs_antimeridian", "airports_without_recent_obs"]


@pytest.mark.parametrize("name", NAMES)
def test_as_of_the_newest_changes_nothing(spark, sf_dir, name):
    newest = weather.role(spark, sf_dir, "metar").agg({"seen_at": "max"}).first()[0]
    f = weather.queries()[name]
    assert sorted(map(tuple, f(spark, sf_dir, as_of=newest).collect()), key=repr) == sorted(map(tuple, f(spark, sf_dir).collect()), key=repr)


def test_as_of_reaches_the_scan(spark, sf_dir):
    newest = weather.role(spark, sf_dir, "metar").agg({"seen_at": "max"}).first()[0]
    before = weather.recent(spark, sf_dir, as_of=newest - weather.timedelta(days=5))
    assert before.count() and before.where("seen_at > now or seen_at < now - interval 2 days").isEmpty()
    plan = before._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan and "Join" not in plan
