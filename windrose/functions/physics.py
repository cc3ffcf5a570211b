"""Weather formulas as columns; results are rounded where engines differ in the last bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fahrenheit(celsius: Column) -> Column:
    return celsius * 9.0 / 5.0 + 32.0


def heat_index_f(t: Column, dewpoint_f: Column) -> Column:
    """Regression in °F with linear humidity, from 80 °F up, and only if it exceeds the temperature."""
    rh = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - (t - dewpoint_f) * 25.0 / 9.0))
    hi = (
        -42.379 + 2.04901523 * t + 10.14333127 * rh - 0.22475541 * t * rh - 0.00683783 * t * t
        - 0.05481717 * rh * rh + 0.00122874 * t * t * rh + 0.00085282 * t * rh * rh - 0.00000199 * t * t * rh * rh
    )
    return F.when((t >= 80) & (hi > t), F.round(hi, 4)).otherwise(F.round(t, 4))


def wind_chill_f(t: Column, mph: Column) -> Column:
    v = F.pow(mph, 0.16)
    return F.when((t <= 50) & (mph >= 3), F.round(35.74 + 0.6215 * t - 35.75 * v + 0.4275 * t * v, 6)).otherwise(F.round(t, 6))


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees that the wind comes from."""
    return F.round(F.pmod(270.0 - F.degrees(F.atan2(v, u)), F.lit(360.0)), 6)


def crosswind(speed: Column, direction: Column, heading: Column) -> Column:
    return F.round(F.abs(speed * F.sin(F.radians(direction - heading))), 1) + 0.0


def headwind(speed: Column, direction: Column, heading: Column) -> Column:
    return F.round(speed * F.cos(F.radians(direction - heading)), 1) + 0.0


def dewpoint(celsius: Column, humidity: Column) -> Column:
    g = F.log(humidity / 100.0) + 17.625 * celsius / (243.04 + celsius)
    return F.round(243.04 * g / (17.625 - g), 6)


KNOTS, FEET, STATUTE_MILE = 1.94384, 3.28084, 1609.344


def kelvin_to_celsius(k: Column) -> Column:
    return k - 273.15


def knots(metres_per_second: Column) -> Column:
    return metres_per_second * KNOTS


def wind_speed(u: Column, v: Column) -> Column:
    return F.round(F.sqrt(u * u + v * v), 6)


def direction_of_tens(tens: Column) -> Column:
    """Degrees of a direction in tens of degrees."""
    return F.pmod(F.round(tens * 10), F.lit(360)).cast("int")


def humidity(celsius: Column, dewpoint_c: Column) -> Column:
    """Relative humidity between 0 and 1."""
    part = lambda x: 17.625 * x / (243.04 + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(part(dewpoint_c) - part(celsius))))


def heat_index_c(celsius: Column, dewpoint_c: Column) -> Column:
    """Regression from 27 °C up, else null."""
    t, rh = fahrenheit(celsius), humidity(celsius, dewpoint_c) * 100
    hi = (
        -42.379 + 2.04901523 * t + 10.14333127 * rh - 0.22475541 * t * rh - 0.00683783 * t * t
        - 0.05481717 * rh * rh + 0.00122874 * t * t * rh + 0.00085282 * t * rh * rh - 0.00000199 * t * t * rh * rh
    )
    return F.when(celsius >= 27, F.round((hi - 32) * 5.0 / 9.0, 2))


def wind_chill_c(celsius: Column, speed_kt: Column) -> Column:
    """To 10 °C and from 5 mph, else null; calm where the speed is unknown."""
    mph = F.coalesce(speed_kt, F.lit(0)).cast("double") * 1.15078
    t, v = fahrenheit(celsius), F.pow(mph, 0.16)
    return F.when((celsius <= 10) & (mph >= 5), F.round((35.74 + 0.6215 * t - 35.75 * v + 0.4275 * t * v - 32) * 5.0 / 9.0, 2))


def wbgt(celsius: Column, dewpoint_c: Column, radiation: Column, metres_per_second: Column) -> Column:
    """Wet-bulb globe temperature: wet bulb by humidity, globe by radiation that wind weakens."""
    rh = humidity(celsius, dewpoint_c) * 100
    wet = celsius * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(celsius + rh) - F.atan(rh - 1.676331) + 0.00391838 * F.pow(rh, 1.5) * F.atan(0.023101 * rh) - 4.686035
    weak = F.when(metres_per_second > 0.5, F.greatest(F.lit(0.5), 1.0 - 0.02 * metres_per_second)).otherwise(1.0)
    globe = F.when(radiation > 0, celsius + radiation / 500.0 * 10.0 * weak).otherwise(celsius)
    return F.round(0.7 * wet + 0.2 * globe + 0.1 * celsius, 2)


def best_end(speed: Column, direction: Column, low: Column, high: Column) -> Column:
    """(heading, crosswind) of the runway end with over half a knot more headwind, else with less crosswind."""
    across = lambda h: F.abs(speed * F.sin(F.radians(direction - h)))
    along = lambda h: speed * F.cos(F.radians(direction - h))
    more = along(high) - along(low)
    use = high.isNotNull() & (low.isNull() | (more > 0.5) | ((F.abs(more) <= 0.5) & (across(high) < across(low))))
    heading = F.when(use, high).otherwise(low)
    return F.struct(heading.alias("heading"), F.round(across(heading), 1).alias("crosswind"))


def usable(crosswind: Column, headwind: Column) -> Column:
    return (crosswind <= 15) & (headwind >= -10)
