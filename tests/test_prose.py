"""Forecasts in words, on hand-written texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrose.functions.prose import taf_prose

LONG = """TAF AMD KDCA 061130Z 0612/0718 25010G22KT P6SM -RA SCT020 BKN030CB
     FM061800 VRB05KT 3/4SM +TSRA OVC008
     PROB40 0620/0624 VCTS BR
     TEMPO 0622/0624 00000KT 1 1/2SM FZRA
     BECMG 0700/0702 SKC RMK NXT FCST BY 18Z TEMPO 0708/0710 FG"""


def told(spark, texts, **how):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.t for r in rows.select("i", taf_prose(F.col("text"), **how).alias("t")).orderBy("i").collect()]


def test_all_groups(spark):
    (t,) = told(spark, [LONG], head_words=False)
    assert (t.station, t.issued, t.valid) == ("KDCA", "06/1130Z", "06/1200Z to 07/1800Z")
    assert [(p.kind, p.time) for p in t.periods] == [
        ("INITIAL", None), ("FROM", "06/1800Z"), ("PROBABILITY 40%", None), ("TEMPORARY", None), ("BECOMING", None), ("TEMPORARY", None),
    ]
    assert [p.conditions for p in t.periods] == [
        ["Wind: 250° at 10 knots gusting to 22 knots", "Visibility: >6 statute miles", "Weather: Light rain", "Scattered clouds at 2000 feet", "Broken clouds at 3000 feet"],
        ["Wind: Variable at 05 knots", "Visibility: 3/4 statute miles", "Weather: Heavy thunderstorm with rain", "Overcast at 800 feet"],
        ["Weather: thunderstorm in vicinity", "Weather: mist"],
        ["Wind: 000° at 00 knots", "Visibility: 1/2 statute miles", "Weather: freezing rain"],
        ["Sky clear"],
        ["Weather: fog"],
    ]


def test_head_words_are_named_as_weather(spark):
    (t,) = told(spark, [LONG])
    assert t.periods[0].conditions[:3] == ["Weather: TAF", "Weather: AMD", "Weather: KDCA"]


def test_missing_and_broken_texts(spark):
    null, empty, blank, bare, late = told(spark, [None, "", "  \n ", "nothing to see", "TAF\nKJFK 010000Z 0100/0206 18005KT"])
    assert null is None and empty is None
    assert blank.periods == [] and (blank.station, blank.issued, blank.valid) == (None, None, None)
    assert bare.station is None and [(p.kind, p.conditions) for p in bare.periods] == [("INITIAL", [])]
    # station and times are looked for in the first line only
    assert late.station is None and late.valid is None and late.periods[0].conditions[-1] == "Wind: 180° at 05 knots"


def test_long_text_and_repeated_rows(spark):
    text = "TAF KAAA 010000Z 0100/0206 18005KT" + "\n FM010100 20010KT P6SM SKC" * 3000
    a, b = told(spark, [text, text])
    assert a == b and len(a.periods) == 3001 and a.periods[3000].conditions == ["Wind: 200° at 10 knots", "Visibility: >6 statute miles", "Sky clear"]


def test_letters_that_hold_sm_are_no_visibility(spark):
    (t,) = told(spark, ["TAF KSMQ 010000Z 0100/0206 18005KT P6SM M1/4SM"])
    assert t.periods[0].conditions == ["Weather: TAF", "Weather: KSMQ", "Wind: 180° at 05 knots", "Visibility: >6 statute miles", "Visibility: M1/4 statute miles"]
