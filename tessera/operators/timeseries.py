"""Time series per group. Steps over one group and order share a window, so Spark plans one exchange and one sort."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.frame import AnnotatedFrame
from tessera.functions import geo, scalar
from tessera.plans.step import Step, describe, input, output
from tessera.validation import quoted


def ordered(group: str | None, *order: str) -> WindowSpec:
    """The window of a group in order; without a group a single task orders everything, which does not scale."""
    base = Window.partitionBy(quoted(group)) if group else Window.partitionBy(F.lit(0))
    return base.orderBy(*[quoted(c) for c in order])


def _elapsed(df: AnnotatedFrame, name: str, w: WindowSpec) -> Column:
    """Seconds since the previous row. Numbers are seconds; of times whole microseconds are subtracted.

    Seconds since 1970 as doubles have steps of a quarter of a microsecond: their differences would not be exact.
    """
    if isinstance(df.dtype(name), T.NumericType):
        t = quoted(name).cast("double")
        return t - F.lag(t).over(w)
    t = scalar.micros(quoted(name))
    return (t - F.lag(t).over(w)) / F.lit(1e6)


class _Ordered(Step):
    """``tie_breaker``: further columns that order rows of equal time."""

    tie_breaker: list[str] = []

    def _window(self, sort: str) -> WindowSpec:
        return ordered(self.get_name("group"), self.get_name(sort), *self.tie_breaker)


class AddLocalIndex(_Ordered):
    """Place of a row in its group, from 0, and counted from the end."""

    def __init__(self, tie_breaker: list[str] | None = None):
        self.tie_breaker = list(tie_breaker or [])

    @describe("Index within each group")
    @input({"group": {"representation_type": int}, "sort": {}})
    @output({"local_index": {"representation_type": int}, "reverse_{{local_index}}": {"representation_type": int}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        index = F.row_number().over(self._window("sort")).cast("long") - 1
        size = F.count(F.lit(1)).over(Window.partitionBy(quoted(self.get_name("group"))))
        made = {self.get_name("local_index"): index, self.get_name("reverse_{{local_index}}"): size - 1 - index}
        return df._with(df.withColumns(made), df.spec)


class AddDeltaTime(_Ordered):
    """Seconds since the previous row of the group; 0 for the first."""

    def __init__(self, tie_breaker: list[str] | None = None):
        self.tie_breaker = list(tie_breaker or [])

    @describe("Time since the previous row")
    @input({"group": {"representation_type": int}, "time_column": {}})
    @output({"delta_time": {"unit": "s", "representation_type": float}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        name = self.get_name("time_column")
        w = self._window("time_column")
        if isinstance(df.dtype(name), T.NumericType):
            delta = (quoted(name) - F.lag(quoted(name)).over(w)).cast("double")
        else:
            t = scalar.micros(quoted(name))
            delta = (t - F.lag(t).over(w)) / F.lit(1e6)
        return df._with(df.withColumn(self.get_name("delta_time"), F.coalesce(delta, F.lit(0.0))), df.spec)


class DeltaDistance(_Ordered):
    """Great-circle distance to the previous position of the group; rows without one are dropped.

    ``x_shift``, ``y_shift``: take latitude and longitude of the previous row; one that is not shifted is the row's own.
    """

    def __init__(self, x_shift: bool = True, y_shift: bool = True, radius: float = geo.TRACK_RADIUS, tie_breaker: list[str] | None = None):
        self.x_shift, self.y_shift, self.radius, self.tie_breaker = x_shift, y_shift, radius, list(tie_breaker or [])

    @describe("Distance from the previous row")
    @input({"group": {"representation_type": int}, "sort": {}, "x": {"unit": "deg"}, "y": {"unit": "deg"}})
    @output({"out": {"unit": "km", "representation_type": float}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        w, x, y, out = self._window("sort"), quoted(self.get_name("x")), quoted(self.get_name("y")), self.get_name("out")
        x0, y0 = F.lag(x).over(w) if self.x_shift else x, F.lag(y).over(w) if self.y_shift else y
        made = df.withColumn(out, geo.great_circle_distance(x0, y0, x, y, self.radius))
        return df._with(made.where(quoted(out).isNotNull()), df.spec)


class Heading(_Ordered):
    """Course from the previous longitude to the next latitude, and its change.

    The first and the last row of a group have no course, the first course no change: they are dropped. Changes are taken
    within the group; ``across_groups`` takes them over the whole order instead, in one task, as a check against results
    that were made so.
    """

    def __init__(self, across_groups: bool = False, tie_breaker: list[str] | None = None):
        self.across_groups, self.tie_breaker = across_groups, list(tie_breaker or [])

    @describe("Course and its change")
    @input({"group": {"representation_type": int}, "sort": {}, "lat": {"unit": "deg"}, "lon": {"unit": "deg"}})
    @output({"heading": {"unit": "rad"}, "delta_heading": {"unit": "rad"}, "angular_velocity": {"unit": "rad / s"}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        w, lat, lon = self._window("sort"), quoted(self.get_name("lat")), quoted(self.get_name("lon"))
        heading, delta, speed = (self.get_name(n) for n in ("heading", "delta_heading", "angular_velocity"))
        course = geo.bearing_radians(F.lead(lat).over(w), F.lag(lon).over(w), lat, lon)
        made = df.withColumn(heading, course).where(quoted(heading).isNotNull())
        if self.across_groups:
            w = ordered(None, self.get_name("group"), self.get_name("sort"), *self.tie_breaker)
        change, elapsed = quoted(heading) - F.lag(quoted(heading)).over(w), _elapsed(df, self.get_name("sort"), w)
        made = made.withColumns({delta: change, speed: F.try_divide(change, elapsed)})
        return df._with(made.where(quoted(delta).isNotNull()), df.spec)


class AngularVelocity(_Ordered):
    """Change of heading over the whole seconds since the previous row; null where no second has passed."""

    def __init__(self, tie_breaker: list[str] | None = None):
        self.tie_breaker = list(tie_breaker or [])

    @describe("Change of heading over time")
    @input({"group": {"representation_type": int}, "heading": {"unit": "rad"}, "time": {}})
    @output({"angular_velocity": {"unit": "rad / s"}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        w, h = self._window("time"), quoted(self.get_name("heading"))
        gap = _elapsed(df, self.get_name("time"), w)
        whole = F.when(gap < 0, F.ceil(gap)).otherwise(F.floor(gap)).cast("double")
        return df._with(df.withColumn(self.get_name("angular_velocity"), F.try_divide(h - F.lag(h).over(w), whole)), df.spec)


class Speed(Step):
    """Kilometres per hour from distance and seconds; rows in which no time has passed are dropped."""

    @describe("Speed from distance and time")
    @input({"delta_distance": {"unit": "km"}, "delta_time": {"unit": "s"}})
    @output({"speed": {"unit": "km / h", "representation_type": float}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        d, t = quoted(self.get_name("delta_distance")), quoted(self.get_name("delta_time"))
        kept = df.where(t != 0)
        return df._with(kept.withColumn(self.get_name("speed"), F.try_divide(d, t / F.lit(3600.0))), df.spec)
