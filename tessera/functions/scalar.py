"""Scaling, cyclic encodings, time and identifier functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def normalize(x: Column, x_min: float, x_max: float, a: float = 0.0, b: float = 1.0) -> Column:
    """Linear from [x_min, x_max] to [a, b]."""
    if x_max == x_min:
        raise ValueError("normalize: the range is empty")
    return (x - F.lit(x_min)) * F.lit(b - a) / F.lit(float(x_max - x_min)) + F.lit(a)


def cyclic_normalisation(x: Column, x_min: float, x_max: float) -> tuple[Column, Column]:
    """Sine and cosine of the angle that x has on the circle from x_min to x_max."""
    angle = F.lit(TWO_PI) * normalize(x, x_min, x_max)
    return F.sin(angle), F.cos(angle)


def _clip(x: Column) -> Column:
    return F.when(x > 1, F.lit(1.0)).when(x < -1, F.lit(-1.0)).otherwise(x)


def half_turns(x: Column, x_min: float, x_max: float) -> Column:
    """Whole half turns that x is beyond x_min: what sine and cosine do not tell of values outside of the range."""
    return F.floor(F.lit(2.0) * normalize(x, x_min, x_max))


def cyclic_denormalisation(x_sin: Column, x_cos: Column, x_min: float, x_max: float, halves: Column | None = None) -> Column:
    """The value whose cyclic normalisation has these coordinates. The half turn maps [0, 2 pi] to [-pi, pi].

    Coordinates alone give a value of the range. With ``halves``, the value's ``half_turns``, it is the value itself; half
    turns and not whole ones, so that a place at the end of a turn is not taken for the start of the next.
    """
    s, c = F.sin(F.asin(_clip(x_sin)) - F.lit(math.pi)), F.cos(F.acos(_clip(x_cos)) - F.lit(math.pi))
    angle = F.when(s > 0, F.acos(_clip(c))).otherwise(-F.acos(_clip(c)))
    if halves is None:
        return normalize(angle, -math.pi, math.pi, x_min, x_max)
    place = normalize(angle, -math.pi, math.pi)
    turns = F.floor(halves / 2 + F.lit(0.25) - place + F.lit(0.5))  # the place goes nearest to the middle of its half turn
    return normalize(place + turns, 0, 1, x_min, x_max)


def cycle(x: Column, n: float) -> tuple[Column, Column]:
    """Sine and cosine of 2 pi x, each divided by n afterwards."""
    return F.sin(F.lit(TWO_PI) * x) / F.lit(float(n)), F.cos(F.lit(TWO_PI) * x) / F.lit(float(n))


#: Parts of a timestamp and the length of their cycle.
CALENDAR = {
    "quarter": (F.quarter, 4),
    "week": (F.weekofyear, 53),
    "weekday": (lambda t: F.weekday(t) + 1, 7),
    "hour": (F.hour, 24),
}


def timestamp_cycle(t: Column, part: str) -> tuple[Column, Column]:
    get, n = CALENDAR[part]
    return cycle(get(t), n)


def epoch_seconds(text: Column, fmt: str | None = None) -> Column:
    """Seconds since 1970 of a date text (or timestamp), with whole milliseconds; null stays null, bad text raises."""
    stamp = F.to_timestamp(text, F.lit(fmt)) if fmt else F.to_timestamp(text)
    return F.unix_millis(stamp.cast("timestamp")) / F.lit(1000.0).cast("double")


def try_epoch_seconds(text: Column) -> Column:
    """Like ``epoch_seconds``; text that is no date gives NaN."""
    parsed = F.try_to_timestamp(text)
    seconds = F.unix_millis(parsed.cast("timestamp")) / F.lit(1000.0).cast("double")
    return F.when(text.isNotNull() & parsed.isNull(), F.lit(float("nan"))).otherwise(seconds)


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(t.cast("timestamp"))


def mmsi_country(mmsi: Column) -> Column:
    """The leading digits of a ship station identity: its country."""
    value = mmsi.cast("long")
    return F.floor((value - value % 1_000_000) / 1_000_000).cast("long")


def mmsi_national(mmsi: Column) -> Column:
    return mmsi.cast("long") % 1_000_000


def fill_undefined(x: Column, value: object, floating: bool) -> Column:
    """Null and NaN replaced."""
    return F.coalesce(F.nanvl(x, F.lit(value).cast("double")), F.lit(value)) if floating else F.coalesce(x, F.lit(value))


def strict_lookup(x: Column, mapping: dict, what: str = "value") -> Column:
    """The mapped value; null stays null, a value without a mapping is an error of the query."""
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    found = F.try_element_at(F.create_map(*pairs), x) if pairs else F.lit(None)
    unknown = F.raise_error(F.concat(F.lit(f"unknown {what}: "), x.cast("string")))
    return F.when(x.isNull(), F.lit(None)).when(found.isNotNull(), found).otherwise(unknown)
