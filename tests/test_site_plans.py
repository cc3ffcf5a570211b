"""Plans of the site queries: what makes pairs comes last, so that no pair is shuffled."""

from __future__ import annotations

import re

import pytest

from windrose.plans import sites, weather  # noqa: F401


def planned(spark, sf_dir, name):
    return weather.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["station_neighbours", "wind_map", "incident_reports"])
def test_pairs_are_made_last(spark, sf_dir, name):
    plan = planned(spark, sf_dir, name)
    first = re.search(r"(\w*Join\w*) \[([^\]]*)\]", plan)
    assert first[1] == "SortMergeJoin" and "cy#" in first[2] and "Exchange" not in plan[: first.start()]


def test_stoplight_pairs_no_site_with_all_flashes(spark, sf_dir):
    assert "bool_or" not in planned(spark, sf_dir, "current_stoplight")
