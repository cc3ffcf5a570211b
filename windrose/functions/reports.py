"""Weather reports, forecasts and warnings in text, decoded by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIND = r"\b(\d{3}|VRB)(\d{2,3})(?:G(\d{2,3}))?KT\b"


def _part(text: Column, form: str, i: int) -> Column:
    """A group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(text, form, i), F.lit(""))


def _signed(text: Column) -> Column:
    """Degrees where M stands for minus."""
    return F.when(text.startswith("M"), -F.substring(text, 2, 2).cast("int")).otherwise(F.try_to_number(text, F.lit("99"))).cast("double")


def split_bulletin(text: Column) -> Column:
    """Reports of a bulletin: they end at "=" or before a line that starts one; a bare "KDCA 061452Z" line gets the collective's word."""
    marked = F.regexp_replace(text, r"(?m)^(?=(?:METAR |SPECI )?[A-Z][A-Z0-9]{3} \d{6}Z)", "=")
    one = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    named = lambda x: F.when(x.rlike(r"^[A-Z][A-Z0-9]{3} \d{6}Z"), F.concat(F.lit("METAR "), x)).otherwise(x)
    return F.filter(F.transform(F.split(marked, "="), lambda x: named(one(x))), lambda x: x.rlike(r"^(METAR|SPECI) "))


def sky(text: Column) -> Column:
    """Layers (cover, height_ft)."""
    found = F.regexp_extract_all(text, F.lit(r"\b((?:FEW|SCT|BKN|OVC|VV)\d{3})"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, "^[A-Z]+", 0).alias("cover"), (F.regexp_extract(x, r"\d+", 0).cast("int") * 100).alias("height_ft")))


def ceiling(layers: Column) -> Column:
    """The lowest broken or overcast layer."""
    return F.array_min(F.transform(F.filter(layers, lambda x: x["cover"].isin("BKN", "OVC")), lambda x: x["height_ft"]))


def visibility(text: Column) -> Column:
    """Statute miles, also of fractions such as 1 1/2SM."""
    form = r"(?:^| )[PM]?(?:(\d+) )?(?:(\d+)/(\d+)|(\d+))SM\b"
    whole, top, under, plain = (_part(text, form, i).cast("double") for i in (1, 2, 3, 4))
    return F.coalesce(plain, F.coalesce(whole, F.lit(0.0)) + top / under)


def present_weather(text: Column) -> Column:
    form = r"(?<= )((?:\+|-|VC)?(?:MI|PR|BC|DR|BL|SH|TS|FZ)?(?:DZ|RA|SN|SG|IC|PL|GR|GS|UP|BR|FG|FU|VA|DU|SA|HZ|PY|PO|SQ|FC|SS|DS|TS)+)(?= |$)"
    return F.regexp_extract_all(F.regexp_extract(text, r"^(.*?)(?: RMK.*)?$", 1), F.lit(form), F.lit(1))


def precipitation_type(weather: Column) -> Column:
    """The first of freezing rain, hail, snow, sleet and rain that the groups name, wherever its letters stand."""
    text = F.upper(F.array_join(weather, " "))
    out = None
    for kind, form in (("fzra", "FZRA|FZDZ"), ("hail", "GR|GS"), ("snow", "SN|SG"), ("sleet", "PL|IC"), ("rain", "RA|DZ")):
        out = F.when(text.rlike(form), kind) if out is None else out.when(text.rlike(form), kind)
    return out


def metar(text: Column, year: Column, month: Column, received: Column | None = None) -> Column:
    """All fields of a report; null where the station or temperature is missing. Year and month are those of its receipt: a day that the month lacks is of the
    month before. Given the time of receipt itself, a day far ahead of it is of the month before, too."""
    station, at = (_part(text, r"^(?:METAR |SPECI )?(?:COR )?([A-Z][A-Z0-9]{3}) (\d{6})Z", i) for i in (1, 2))
    degrees = r" (M?\d{2})/(M?\d{2})?(?= |$)"
    temperature, dew = _signed(_part(text, degrees, 1)), _signed(_part(text, degrees, 2))
    number = lambda i: F.substring(at, i, 2).cast("int")
    made = lambda year, month: F.try_make_timestamp_ntz(year, month, number(1), number(3), number(5), F.lit(0))
    seen = day_time(at, received) if received is not None else F.coalesce(made(year, month), made(F.when(month == 1, year - 1).otherwise(year), F.when(month == 1, 12).otherwise(month - 1)))
    fields = {
        "station_id": station, "observation_time": seen, "is_speci": text.startswith("SPECI"),
        "temp_c": temperature, "dewpoint_c": dew, "wind_dir": F.nullif(_part(text, WIND, 1), F.lit("VRB")).cast("int"),
        "wind_speed_kts": _part(text, WIND, 2).cast("int"), "wind_gust_kts": _part(text, WIND, 3).cast("int"), "visibility_sm": visibility(text),
        "altimeter_hg": _part(text, r" A(\d{4})(?= |$)", 1).cast("double") / 100, "ceiling_ft": ceiling(sky(text)), "weather": present_weather(text),
    }
    return F.when(station.isNotNull() & temperature.isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))


def day_time(text: Column, reference: Column) -> Column:
    """The time of ddhhmm in the month of ``reference``, or the month before where it would be over 15 days ahead; hour 24 is the next day's 0."""
    number = lambda i: F.substring(text, i, 2).cast("int")
    minute = F.coalesce(F.nullif(F.substring(text, 5, 2), F.lit("")).cast("int"), F.lit(0))

    def of(month: Column) -> Column:
        day = F.try_make_timestamp_ntz(F.year(month), F.month(month), number(1), F.lit(0), F.lit(0), F.lit(0))
        return day + F.make_dt_interval(F.lit(0), number(3), minute, F.lit(0))

    here = of(reference)
    return F.when((here > reference + F.expr("interval 15 days")) | here.isNull(), of(F.add_months(reference, -1))).otherwise(here)


def valid_period(text: Column, issued: Column) -> Column:
    """(start, end) of ddhh/ddhh; a day before the issue's is of the next month."""
    def of(x: Column) -> Column:
        day, first = F.substring(x, 1, 2).cast("int"), F.trunc(issued, "month").cast("timestamp_ntz")
        month = F.when(day < F.dayofmonth(issued) - 1, F.add_months(first, 1).cast("timestamp_ntz")).otherwise(first)
        return month + F.make_dt_interval(day - 1, F.substring(x, 3, 2).cast("int"), F.lit(0), F.lit(0))

    parts = F.split(text, "/")
    return F.when(text.rlike(r"^\d{4}/\d{4}$"), F.struct(of(parts[0]).alias("start"), of(F.get(parts, F.lit(1))).alias("end")))


TAF_HEAD = r"(?:TAF )?(?:TAF )?(?:AMD |COR )?([A-Z][A-Z0-9]{3}) (\d{6})Z (\d{4}/\d{4})"


def split_tafs(text: Column) -> Column:
    """Forecasts of a bulletin as one line each: from a head up to "=" or the next head; other lines go."""
    flat = F.regexp_replace(text, r"\s+", " ")
    found = F.regexp_extract_all(flat, F.lit(rf"({TAF_HEAD}.*?)(?==|(?:TAF (?:AMD |COR )?)?\b[A-Z][A-Z0-9]{{3}} \d{{6}}Z \d{{4}}/\d{{4}}|$)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.regexp_extract(x, TAF_HEAD, 1).rlike("^[KPTC]"))


def taf_periods(text: Column) -> Column:
    """Change groups (kind, span, probability, direction, speed, gust) of a forecast line that have a wind; the head is INITIAL."""
    parts = F.split(F.regexp_replace(text, r" (?=FM\d{6}|TEMPO \d{4}/|BECMG \d{4}/|PROB\d{2} (?:TEMPO )?\d{4}/)", "\n"), "\n")

    def group(x: Column, i: Column) -> Column:
        head = F.when(i == 0, "INITIAL").otherwise(_part(x, r"^(FM|TEMPO|BECMG|PROB)", 1))
        span = F.when(i == 0, _part(x, TAF_HEAD, 3)).otherwise(F.coalesce(_part(x, r"^FM(\d{6})", 1), _part(x, r"(\d{4}/\d{4})", 1)))
        fields = {"kind": head, "span": span, "probability": _part(x, r"^PROB(\d{2})", 1).cast("int"), "direction": F.nullif(_part(x, WIND, 1), F.lit("VRB")).cast("int"), "speed": _part(x, WIND, 2).cast("int"), "gust": _part(x, WIND, 3).cast("int")}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    return F.filter(F.transform(parts, group), lambda g: g["speed"].isNotNull())


def mentions(text: Column, station: Column) -> Column:
    """Whether a raw forecast is the station's own."""
    return F.array_contains(F.slice(F.split(F.trim(text), r"\s+"), 1, 4), station)


VTEC = r"/([OTE])\.(NEW|CON|EXT|EXA|EXB|UPG|CAN|EXP|COR)\.([A-Z]{4})\.([A-Z]{2})\.([A-Z])\.(\d{4})\.(\d{6}T\d{4}Z)-(\d{6}T\d{4}Z)/"


def events_of(text: Column) -> Column:
    """Operational event codes of a product, each with its segment: what stands between the "$$" around it. A second copy of the product goes."""
    once = F.regexp_replace(text, r"(?s)^(\s*\d*\s*([A-Z]{4}\d{2} [A-Z]{4} \d{6}).*?)\s\2.*$", "$1")
    def time(x: Column) -> Column:
        return F.when(x != "000000T0000Z", F.try_to_timestamp(F.concat(F.lit("20"), x), F.lit("yyyyMMdd'T'HHmm'Z'")).cast("timestamp_ntz"))

    def event(code: Column, segment: Column) -> Column:
        part = lambda i: F.regexp_extract(code, VTEC, i)
        fields = {"action": part(2), "office": part(3), "phenomenon": part(4), "significance": part(5), "number": part(6).cast("int"), "begins": time(part(7)), "ends": time(part(8)), "segment": segment}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    codes = lambda s: F.regexp_extract_all(s, F.lit(f"({VTEC.replace('(', '(?:')})"), F.lit(1))
    all_ = F.flatten(F.transform(F.split(once, r"\$\$"), lambda s: F.transform(codes(s), lambda c: F.struct(c.alias("c"), s.alias("s")))))
    return F.transform(F.filter(all_, lambda x: x["c"].startswith("/O.")), lambda x: event(x["c"], x["s"]))


def zones(text: Column) -> Column:
    """Zone codes of INZ001-003>005-KYZ002-130100-: a bare number keeps the last state and kind, and a range names all between its ends."""
    line = F.regexp_replace(F.regexp_extract(text, r"(?m)^([A-Z]{2}[CZ]\d{3}(?:[->]\s*(?:[A-Z]{2}[CZ])?\d{3}(?!\d))*)", 1), r"\s", "")

    def step(s: Column, x: Column) -> Column:
        head = F.when(x.rlike("^[A-Z]"), F.substring(x, 1, 3)).otherwise(s["head"])
        first, last = [F.regexp_extract(x, form, 1).cast("int") for form in (r"^[A-Z]*(\d{3})", r"(\d{3})$")]
        named = F.transform(F.sequence(first, F.greatest(first, last)), lambda n: F.concat(head, F.lpad(n.cast("string"), 3, "0")))
        return F.struct(head.alias("head"), F.concat(s["out"], named).alias("out"))

    start = F.struct(F.lit("").alias("head"), F.array().cast("array<string>").alias("out"))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.aggregate(F.split(line, "-"), start, step)["out"])


def warning_ring(text: Column) -> Column:
    """The closed ring of a LAT...LON block in hundredths of a degree, west counted positive; null under three corners."""
    numbers = F.transform(F.filter(F.split(F.regexp_extract(text, r"LAT\.\.\.LON((?:\s+\d{3,5})+)", 1), r"\s+"), lambda x: x != ""), lambda x: x.cast("double") / 100)
    corners = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 1), lambda i: F.struct((-F.get(numbers, 2 * i + 1)).alias("lon"), F.get(numbers, 2 * i).alias("lat")))
    return F.when((F.size(numbers) >= 6) & (F.size(numbers) % 2 == 0), F.concat(corners, F.slice(corners, 1, 1)))


def storm_motion(text: Column) -> Column:
    """(degrees, knots) of TIME...MOT...LOC."""
    form = r"TIME\.\.\.MOT\.\.\.LOC\s+\d{4}Z\s+(\d{1,3})DEG\s+(\d{1,3})KT"
    return F.when(text.rlike(form), F.struct(_part(text, form, 1).cast("int").alias("degrees"), _part(text, form, 2).cast("int").alias("knots")))


def storm_track(text: Column) -> Column:
    """(degrees, knots, lat, lon) of TIME...MOT...LOC with a place in hundredths of a degree, west counted positive, or of STORM_MOTION: 245DEG 35KT LOC 38.56,-96.53."""
    forms = (r"TIME\.\.\.MOT\.\.\.LOC\s+\d{4}Z\s+(\d{1,3})DEG\s+(\d{1,3})KT(?:\s+(\d{4})\s+(\d{4,5}))?", r"STORM_MOTION:\s*(\d+)DEG\s+(\d+)KT(?:\s+LOC\s+([\d.-]+),([\d.-]+))?")
    part = lambda form, i, kind: F.nullif(F.regexp_extract(text, form, i), F.lit("")).try_cast(kind)
    track = lambda form, lat, lon: F.struct(part(form, 1, "int").alias("degrees"), part(form, 2, "int").alias("knots"), (part(form, 3, "double") * lat).alias("lat"), (part(form, 4, "double") * lon).alias("lon"))
    return F.when(text.rlike(forms[0]), track(forms[0], 0.01, -0.01)).when(text.rlike(forms[1]), track(forms[1], 1.0, 1.0))


def granule_time(name: Column) -> Column:
    """Start of a granule named ..._sYYYYDDDHHMMSSt_..."""
    part = lambda i: _part(name, r"_s(\d{4})(\d{3})(\d{2})(\d{2})(\d{2})\d_", i).cast("int")
    return F.try_make_timestamp_ntz(part(1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(part(2) - 1, part(3), part(4), part(5))


def radar_message(text: Column) -> Column:
    """Status of a free-text radar message: failure, then maintenance, then test, then operation; maintenance outranks failure."""
    has = lambda words: F.upper(text).rlike(words)
    failed, kept = has("FAIL|DOWN|OFFLINE|INOPERATIVE|OUT OF SERVICE"), has("MAINTENANCE|MAINT|SCHEDULED")
    running = has(r"VCP\s*\d+") | has("RESUME|OPERATIONAL|NORMAL|OPERATING")
    return F.when(kept, "MAINTENANCE").when(failed, "FAILED").when(running, "OPERATIONAL").when(has("TEST"), "TEST").otherwise("UNKNOWN")


def identifier(icao: Column, gps: Column, ident: Column) -> Column:
    """The first of three codes that has four characters and no hyphen."""
    good = lambda x: F.when((F.length(F.trim(x)) == 4) & ~x.contains("-"), F.trim(x))
    return F.coalesce(good(icao), good(gps), good(ident))


#: How paved surfaces begin, and what mixed ones name.
PAVED, MIXED = "ASP|CON|PEM", "GRVL|GRAVEL|DIRT|TURF|GRASS|SALT|SAND"


def paved(surface: Column) -> Column:
    """Paved and not mixed; unknown is not paved."""
    return F.coalesce(F.upper(surface).rlike(f"^(?:{PAVED})") & ~F.upper(surface).rlike(MIXED), F.lit(False))


def military(name: Column) -> Column:
    return F.coalesce(name.rlike(r"(?i)\b(?:AFB|AIR FORCE BASE|AAF|ARMY AIRFIELD|NAS|NAVAL AIR STATION|MCAS|ANGB|AIR NATIONAL GUARD|JOINT BASE)\b"), F.lit(False))


def phone(text: Column) -> Column:
    """The last ten digits, null where there are fewer."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def place(text: Column) -> Column:
    """(lat, lon, station) of a place that is written as two decimals, as degrees, minutes and seconds, or as an identifier."""
    from .geo import degrees_of_dms

    form = r"^\s*(-?\d{1,2}(?:\.\d+)?)\s*[, ]\s*(-?\d{1,3}(?:\.\d+)?)\s*$"
    dms = degrees_of_dms(text)
    lat, lon = F.coalesce(_part(text, form, 1).cast("double"), dms["lat"]), F.coalesce(_part(text, form, 2).cast("double"), dms["lon"])
    return F.struct(lat.alias("lat"), lon.alias("lon"), F.when(lat.isNull(), _part(F.upper(text), r"^\s*([A-Z][A-Z0-9]{2,3})\s*$", 1)).alias("station"))


def json_array(text: Column) -> Column:
    """Strings of a JSON list; anything else is an empty list."""
    return F.coalesce(F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")), F.array().cast("array<string>"))


def iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def preview(text: Column, characters: int = 100) -> Column:
    return F.substring(text, 1, characters)


def advisory(text: Column) -> Column:
    """(hazard, ring of DDMMN DDDMMW corners, severity) of an advisory's text; an unclosed ring is closed."""
    hazard = None
    for kind, form in (("ICE", r"\bICE\b|\bICG\b"), ("TURB", r"\bTURB"), ("CONVECTIVE", r"CONVECTIVE|\bTS\b|TSTM"), ("IFR", r"\bIFR\b"), ("MTN_OBSCN", r"MTN OBSC"), ("ASH", r"\bVA\b|VOLCANIC ASH"), ("WIND", r"SFC WIND|\bLLWS\b")):
        hazard = F.when(text.rlike(form), kind) if hazard is None else hazard.when(text.rlike(form), kind)
    found = F.regexp_extract_all(text, F.lit(r"([NS]\d{4} [EW]\d{5})"), F.lit(1))
    angle = lambda x, at, size, minus: (F.substring(x, at, size).cast("double") + F.substring(x, at + size, 2).cast("double") / 60) * F.when(x.contains(minus), -1).otherwise(1)
    ring = F.transform(found, lambda x: F.struct(angle(x, 8, 3, "W").alias("lon"), angle(x, 2, 2, "S").alias("lat")))
    closed = F.when(F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    severity = F.when(text.rlike(r"\bEXTRM|EXTREME"), "EXTREME").when(text.rlike(r"\bSEV"), "SEVERE").when(text.rlike(r"\bMOD"), "MODERATE").when(text.rlike(r"\bLGT|LIGHT"), "LIGHT")
    return F.struct(hazard.alias("hazard"), F.when(F.size(ring) >= 3, closed).alias("ring"), severity.alias("severity"))
