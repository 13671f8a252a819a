"""Allowed values of a column. Each range tests Python values, emits a Spark predicate and merges with others."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-7


def _missing(value: object) -> bool:
    return value is None or isinstance(value, float) and math.isnan(value) or str(value) == "NaT"


class ListOfValues:
    """Membership in a list."""

    def __init__(self, values: Sequence):
        if not isinstance(values, (list, tuple, set, frozenset)):
            raise ValueError(f"ListOfValues: a list is needed, got {type(values).__name__}")
        self.values = list(values)

    def is_in_range(self, value: object) -> bool:
        return value in self.values

    def predicate(self, column: Column) -> Column:
        """True where the value is listed; null counts as listed only if None is."""
        known = [v for v in self.values if v is not None]
        inside = F.coalesce(column.isin(known), F.lit(False)) if known else F.lit(False)
        return inside | column.isNull() if None in self.values else inside

    def merge(self, other: ListOfValues | MinMax) -> ListOfValues | MinMax:
        if isinstance(other, MinMax):
            return other.merge(self)
        both = {*self.values, *other.values}
        return ListOfValues(sorted(v for v in both if v is not None) + [None] * (None in both))

    def __contains__(self, value: object) -> bool:
        return self.is_in_range(value)

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.values == other.values

    def __hash__(self) -> int:
        return hash(tuple(map(str, self.values)))

    def __repr__(self) -> str:
        return f"ListOfValues({self.values})"

    def to_dict(self) -> dict:
        return {"ListOfValues": list(self.values)}


class MinMax:
    """Inclusive bounds; floats get a small tolerance; null and NaN are inside only if missing values are allowed."""

    def __init__(self, min: object, max: object, allow_missing: bool = True):  # noqa: A002
        if min is None or max is None:
            raise ValueError("MinMax: both bounds are needed")
        if min > max:
            raise RuntimeError(f"MinMax: minimum {min} is greater than maximum {max}")
        self.min, self.max, self.allow_missing = min, max, allow_missing

    @property
    def _slack(self) -> float:
        return TOLERANCE if isinstance(self.min, float) or isinstance(self.max, float) else 0

    def is_in_range(self, value: object) -> bool:
        if _missing(value):
            return self.allow_missing
        return self.min - self._slack <= value <= self.max + self._slack if self._slack else self.min <= value <= self.max

    def covers(self, other: MinMax) -> bool:
        return self.min <= other.min and other.max <= self.max

    def outside(self, column: Column) -> Column:
        """True where a value is present and beyond the bounds; NaN is greater than any bound. Null for null."""
        return (column < F.lit(self.min)) | (column > F.lit(self.max))

    def predicate(self, column: Column) -> Column:
        inside = column.between(F.lit(self.min), F.lit(self.max))
        return F.coalesce(inside, F.lit(self.allow_missing))

    def merge(self, other: MinMax | ListOfValues) -> MinMax:
        if isinstance(other, ListOfValues):
            known = [v for v in other.values if v is not None]
            return type(self)(min(self.min, *known), max(self.max, *known), self.allow_missing) if known else self
        return type(self)(min(self.min, other.min), max(self.max, other.max), self.allow_missing and other.allow_missing)

    def __contains__(self, value: object) -> bool:
        return self.is_in_range(value)

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and (self.min, self.max, self.allow_missing) == (other.min, other.max, other.allow_missing)

    def __hash__(self) -> int:
        return hash((type(self).__name__, self.min, self.max))

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.min}, {self.max}, allow_missing={self.allow_missing})"

    def to_dict(self) -> dict:
        show = lambda v: v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v
        return {type(self).__name__: {"min": show(self.min), "max": show(self.max), "allow_missing": self.allow_missing}}


class CyclicMinMax(MinMax):
    """Bounds of values that wrap around, such as angles."""


Range = ListOfValues | MinMax


def from_dict(data: dict, convert=lambda v: v) -> Range:
    """The inverse of ``to_dict``; leaves its input alone. ``convert`` turns stored bounds into values of the type."""
    if not isinstance(data, dict) or len(data) != 1:
        raise ValueError(f"Range: one of ListOfValues, MinMax, CyclicMinMax is needed, got {data!r}")
    kind, body = next(iter(data.items()))
    if kind == "ListOfValues":
        values = [convert(v) for v in body]
        for value in values:
            if value is not None:
                raw = next(v for v in body if v is not None)
                if isinstance(raw, bool) != isinstance(value, bool) or isinstance(raw, str) and isinstance(value, (int, float)):
                    raise ValueError(f"ListOfValues: {raw!r} is not of the column's type")
                break
        return ListOfValues(values)
    if kind not in ("MinMax", "CyclicMinMax"):
        raise ValueError(f"Range: '{kind}' is not known")
    made = MinMax if kind == "MinMax" else CyclicMinMax
    return made(convert(body["min"]), convert(body["max"]), body.get("allow_missing", True))
