"""Steps that change or add columns row by row."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.frame import AnnotatedFrame
from tessera.functions import scalar
from tessera.model.ranges import MinMax
from tessera.model.types import is_floating, resolve
from tessera.plans.step import Step, describe, input, output
from tessera.validation import quoted


class MultiplyValue(Step):
    """x times a constant."""

    def __init__(self, mul_value: float):
        self.mul_value = mul_value

    @describe("Multiply a column by a value")
    @input({"x": {}})
    @output({"x": {}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        name = self.get_name("x")
        return df._with(df.withColumn(name, quoted(name) * F.lit(self.mul_value)), df.spec)


class AddUndefinedValue(Step):
    """Null and NaN become a value."""

    def __init__(self, fill_value: object):
        self.fill_value = fill_value

    @describe("Fill in missing values")
    @input({"x": {}})
    @output({"x": {}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        name = self.get_name("x")
        return df._with(df.withColumn(name, scalar.fill_undefined(quoted(name), self.fill_value, is_floating(df.dtype(name)))), df.spec)


class ChangeTypeColumn(Step):
    """y = x as another type. A cast that would overflow or cannot parse is an error of the query."""

    def __init__(self, new_type: object):
        try:
            resolve(new_type)
        except ValueError as e:
            raise TypeError(f"ChangeTypeColumn: {e}") from e
        self.new_type = new_type if isinstance(new_type, str) else getattr(new_type, "__name__", None) or resolve(new_type).simpleString()

    @describe("Change the type of a column")
    @input({"x": {}})
    @output({"y": {}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        y = self.get_name("y")
        return df._with(df.withColumn(y, quoted(self.get_name("x")).cast(resolve(self.new_type))), df.spec)


class AddTimestamp(Step):
    """Epoch seconds, with milliseconds, from date text or timestamps; both fit, so the contract asks for neither type."""

    @describe("Seconds since 1970 from a date")
    @input({"from": {}})
    @output({"to": {"unit": "s", "representation_type": float}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        return df._with(df.withColumn(self.get_name("to"), scalar.epoch_seconds(quoted(self.get_name("from")))), df.spec)


class CycleTransformer(Step):
    """Sine and cosine of 2 pi x over n, as ``{{x}}_x`` and ``{{x}}_y``."""

    def __init__(self, n: float):
        self.n = n

    @describe("Cyclic encoding")
    @input({"x": {}})
    @output({"{{x}}_x": {"value_range": MinMax(-1.0, 1.0)}, "{{x}}_y": {"value_range": MinMax(-1.0, 1.0)}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        name = self.get_name("x")
        s, c = scalar.cycle(quoted(name), self.n)
        return df._with(df.withColumns({self.get_name("{{x}}_x"): s, self.get_name("{{x}}_y"): c}), df.spec)


class TimestampCycleTransformer(Step):
    """Cyclic encodings of quarter, week, weekday (Monday is 1) and hour of a timestamp: eight columns."""

    @describe("Cyclic encoding of a timestamp")
    @input({"x": {}})
    @output({f"{{{{x}}}}_{part}_{axis}": {"value_range": MinMax(-1.0, 1.0)} for part in scalar.CALENDAR for axis in "xy"})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        made = {}
        for part in scalar.CALENDAR:
            s, c = scalar.timestamp_cycle(quoted(self.get_name("x")), part)
            made |= {self.get_name(f"{{{{x}}}}_{part}_x"): s, self.get_name(f"{{{{x}}}}_{part}_y"): c}
        return df._with(df.withColumns(made), df.spec)


class MultiCycleTransformer(Step):
    """``CycleTransformer`` for several columns at once."""

    def __init__(self, features: list[str], n: float):
        self.features, self.n = list(features), n

    @describe("Cyclic encoding of several columns")
    @input({})
    @output({})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        for feature in self.features:
            df = CycleTransformer(self.n).map_names({"x": self.get_name(feature)}).transform(df)
        return df


class Normalize(Step):
    """``{{x}}_normalized``: x from its bounds to [a, b]; bounds not given come from the column's specification."""

    def __init__(self, x_min: float | None = None, x_max: float | None = None, a: float = 0.0, b: float = 1.0):
        self.x_min, self.x_max, self.a, self.b = x_min, x_max, a, b

    @describe("Scale a column to a range")
    @input({"x": {}})
    @output({"{{x}}_normalized": {"representation_type": float}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        name, low, high = self.get_name("x"), self.x_min, self.x_max
        if low is None or high is None:
            known = df.spec[name].value_range
            low, high = (known.min, known.max) if isinstance(known, MinMax) else df.minmax(name)
        made = scalar.normalize(quoted(name).cast(T.DoubleType()), low, high, self.a, self.b)
        return df._with(df.withColumn(self.get_name("{{x}}_normalized"), made), df.spec)
