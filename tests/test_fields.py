"""Queries on fields, warnings and polygons equal their SQL."""

from __future__ import annotations

import pytest
from oracle import compare

import windrose.plans.alerts as alerts
import windrose.plans.fields as fields
from windrose.plans import weather


@pytest.mark.parametrize("name", [n for n in weather.oracle_sql() if getattr(weather.queries()[n], "__module__", "") in (alerts.__name__, fields.__name__)])
def test_equals_sql(spark, sf_dir, name):
    compare(weather.queries()[name](spark, sf_dir), weather.oracle_sql()[name], sf_dir)


def test_wind_surface_is_whole(spark, sf_dir):
    rows = fields.wind_surface(spark, sf_dir).collect()
    assert len(rows) == 27 * 60 and all(r.value is not None for r in rows) and any(r.inside for r in rows)
