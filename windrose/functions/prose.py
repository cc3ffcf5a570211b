"""Forecasts in words: column expressions, so that no text leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words for weather groups and for layers of cloud.
WEATHER = {
    "RA": "rain", "SN": "snow", "DZ": "drizzle", "FG": "fog", "BR": "mist", "HZ": "haze", "TS": "thunderstorm", "TSRA": "thunderstorm with rain",
    "SHRA": "rain showers", "SHSN": "snow showers", "FZ": "freezing", "FZRA": "freezing rain", "PL": "ice pellets", "GR": "hail", "SQ": "squalls",
    "FC": "funnel cloud", "VA": "volcanic ash", "DU": "dust", "SA": "sand", "SS": "sandstorm", "DS": "duststorm", "PO": "dust devils",
    "VCSH": "showers in vicinity", "VCTS": "thunderstorm in vicinity",
}
LAYERS = {"SKC": "Sky clear", "CLR": "Clear", "FEW": "Few clouds", "SCT": "Scattered clouds", "BKN": "Broken clouds", "OVC": "Overcast"}

_MARK, _END = "\u0001", "\u0002"


def _named(table: dict[str, str], code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), code)


def clock(digits: Column) -> Column:
    """DDHHMM or DDHH as DD/HHMMZ; other texts stay as they are."""
    full = F.when(F.length(digits) == 4, F.concat(digits, F.lit("00"))).otherwise(digits)
    return F.when(F.length(full) == 6, F.concat(F.substring(full, 1, 2), F.lit("/"), F.substring(full, 3, 4), F.lit("Z"))).otherwise(digits)


def phrase(group: Column) -> Column:
    """One group in words: wind, visibility, cloud or weather, in this order; null for any other."""
    of = lambda form, i: F.regexp_extract(group, form, i)
    wind = r"^(\d{3}|VRB)(\d{2,3})(?:G(\d{2,3}))?KT"
    gust = F.when(of(wind, 3) != "", F.concat(F.lit(" gusting to "), of(wind, 3), F.lit(" knots"))).otherwise("")
    origin = F.when(of(wind, 1) == "VRB", "Variable").otherwise(F.concat(of(wind, 1), F.lit("°")))
    layer = r"^(SKC|CLR|FEW|SCT|BKN|OVC)(\d{3})?"
    height = F.when(of(layer, 2) != "", F.concat(F.lit(" at "), (of(layer, 2).cast("int") * 100).cast("string"), F.lit(" feet"))).otherwise("")
    weather = r"^([+-]?)([A-Z]{2,})$"
    code, force = of(weather, 2), F.when(of(weather, 1) == "+", "Heavy ").when(of(weather, 1) == "-", "Light ").otherwise("")
    return (
        F.when(group.rlike(wind), F.concat(F.lit("Wind: "), origin, F.lit(" at "), of(wind, 2), F.lit(" knots"), gust))
        .when(group.contains("SM") & ~group.rlike(weather), F.concat(F.lit("Visibility: "), F.replace(F.replace(group, F.lit("SM"), F.lit("")), F.lit("P"), F.lit(">")), F.lit(" statute miles")))
        .when(group.rlike(layer), F.concat(_named(LAYERS, of(layer, 1)), height))
        .when(group.rlike(weather) & ~group.startswith("FM") & ~group.isin("TEMPO", "BECMG", "RMK"), F.concat(F.lit("Weather: "), force, F.coalesce(_named(WEATHER, code), code)))
    )


def conditions(text: Column) -> Column:
    """The phrases of a change group's text, up to its remarks."""
    groups = F.filter(F.split(text, r"\s+"), lambda g: g != "")
    remarks = F.array_position(groups, "RMK")
    before = F.slice(groups, F.lit(1), F.when(remarks > 0, remarks - 1).otherwise(F.size(groups)).cast("int"))
    return F.filter(F.transform(before, phrase), lambda p: p.isNotNull())


def taf_prose(text: Column, head_words: bool = True) -> Column:
    """(station, issued, valid, periods (kind, time, conditions)) of a forecast; null for a null or empty text.

    Station and times are those of its first line, null where that lacks them. A change group without conditions is a period all the same, so PROB30 TEMPO is two.
    The rule to match takes words of the head, such as TAF and the station's name, for weather, named by themselves; without ``head_words`` they go.
    """
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    head, flat = F.split(whole, "\n")[0], F.replace(whole, F.lit("\n"), F.lit(" "))
    found = lambda form, i=1: F.nullif(F.regexp_extract(head, form, i), F.lit(""))
    span = r"(\d{4})/(\d{4})"
    valid = F.concat(clock(found(span)), F.lit(" to "), clock(found(span, 2)))
    marked = F.regexp_replace(flat, r"\s+(FM\d{6}|TEMPO|BECMG|PROB\d{2})", f"{_MARK}$1{_END}")

    def period(part: Column, i: Column) -> Column:
        sides = F.split(part, _END)
        mark, own = F.when(i > 0, sides[0]), F.element_at(sides, -1)
        if not head_words:
            own = F.when(i == 0, F.regexp_replace(own, r"^(?:TAF\s+)*(?:(?:AMD|COR)\s+)*[A-Z][A-Z0-9]{3}(?=\s|$)", "")).otherwise(own)
        kind = (
            F.when(mark.isNull(), "INITIAL").when(mark.startswith("FM"), "FROM").when(mark == "TEMPO", "TEMPORARY").when(mark == "BECMG", "BECOMING")
            .otherwise(F.concat(F.lit("PROBABILITY "), F.substring(mark, 5, 2), F.lit("%")))
        )
        time = F.when(mark.startswith("FM"), clock(F.substring(mark, 3, 6)))
        return F.struct(kind.alias("kind"), time.alias("time"), conditions(own).alias("conditions"))

    periods = F.when(whole == "", F.expr("array()")).otherwise(F.transform(F.split(marked, _MARK), period))
    fields = {"station": found(r"TAF\s+(?:AMD\s+|COR\s+)?([A-Z]{4})"), "issued": clock(found(r"(\d{6})Z")), "valid": valid, "periods": periods}
    return F.when(text != "", F.struct(*[c.alias(n) for n, c in fields.items()]))
