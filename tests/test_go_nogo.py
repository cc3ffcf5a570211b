"""Go or no-go by each single parameter, and by an airport's own limits."""

from __future__ import annotations

from windrose.plans import weather

FINE = {"speed": 5.0, "xw": 2.0, "ceiling": 9000, "visibility": 9.0, "temp_c": 20.0}


def test_each_parameter_counts(spark):
    cases = [
        ({}, ("G", None, "G", None)), ({"xw": 14.0}, ("Y", "crosswind", "R", "crosswind")), ({"visibility": 0.7}, ("R", "visibility", "Y", "visibility")),
        ({"temp_c": -25.0, "speed": 0.0}, ("R", "temp_cold", "G", None)), ({"temp_c": 41.0}, ("R", "temp_hot", "G", None)), ({"temp_c": -12.0, "speed": 20.0}, ("R", "wind_chill", "G", None)),
        ({"ceiling": 700}, ("R", "ceiling", "Y", "ceiling")), ({"wind_r": 4.0}, ("R", "wind", "R", "wind")), ({"xw": None, "ceiling": None}, ("G", None, "G", None)),
    ]
    names = [*FINE, *weather._LIMITS]
    rows = [(i, *[(FINE | c).get(n) for n in names]) for i, (c, _) in enumerate(cases)]
    schema = "obs_id int, " + ", ".join(f"{n} {'int' if n == 'ceiling' else 'double'}" for n in names)
    got = weather.go_nogo(spark.createDataFrame(rows, schema)).orderBy("obs_id").collect()
    assert [tuple(r)[1:] for r in got] == [want for _, want in cases]
