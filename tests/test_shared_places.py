"""Airports and sites that share places, as ids do after 153,400: the whole answer, in files that keep equal values of neighbouring rows in few bytes."""

from __future__ import annotations

import os

import duckdb
import pytest

from oracle import compare
from windrose.plans import sites, weather  # noqa: F401

#: Ids of ``places`` places, each returning ``times`` times.
_IDS = "(select i + 153400 * j as id from range({places}) a(i), range({times}) b(j))"


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    con = duckdb.connect()
    write = lambda table, rows: con.execute(f"copy (select {rows}) to '{folder}/{table}.parquet' (format parquet)")
    # 150 airports at one place, more than a list holds
    write("customer", f"id::bigint as c_custkey, 'n' as c_name, 1 as c_nationkey from (select id from {_IDS.format(places=200, times=40)} union all select 7 + 153400 * (40 + range) from range(110))")
    write("supplier", f"id::bigint as s_suppkey, 1 as s_nationkey from {_IDS.format(places=200, times=3)}")
    write("lineitem", f"id::bigint as l_partkey, 1::bigint as l_orderkey, timestamp '2024-01-01' as l_shipdate, 1 + (id % 14)::int as l_linenumber, (id % 37)::double as l_quantity, 0.0::double as l_discount from {_IDS.format(places=150, times=40)}")
    write("events", f"""row_number() over ()::bigint as event_id, id::bigint as user_id, timestamp '2024-01-30' - to_microseconds((h * 18000000000 + case when h % 5 = 0 then 0 else id % 977 * 1000 end)::bigint) as ts,
     'click' as event_type, 1.0::double as value, '1' as props from {_IDS.format(places=200, times=4)}, range(120) c(h)""")
    return folder


@pytest.mark.parametrize("name", ["wind_map", "incident_reports"])
def test_whole_answer_in_few_bytes_a_row(spark, shared, tmp_path, name):
    out = str(tmp_path / "out")
    weather.queries()[name](spark, shared).write.parquet(out)
    answer = spark.read.parquet(out)
    compare(answer, weather.oracle_sql()[name], shared)
    files = [f"{out}/{f}" for f in os.listdir(out) if f.endswith(".parquet")]
    held = duckdb.sql(f"select sum(total_compressed_size) from parquet_metadata({files}) where path_in_schema in ('nm', 'site_id')").fetchall()[0][0]
    assert held < 0.2 * answer.count(), held / answer.count()
