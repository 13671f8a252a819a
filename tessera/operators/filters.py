"""Filters, and the small language of filter expressions."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.frame import AnnotatedFrame
from tessera.model.types import is_floating
from tessera.plans.step import Step, describe, input, output
from tessera.validation import quoted

#: Beyond so many values a membership test becomes a semi-join.
LONG_LIST = 1000


class RemoveValueRows(Step):
    """Keep rows whose x differs from a value; rows without a value go too."""

    def __init__(self, remove_value: object):
        self.remove_value = remove_value

    @describe("Remove rows with a value")
    @input({"x": {}})
    @output({"x": {}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        return df._with(df.where(quoted(self.get_name("x")) != F.lit(self.remove_value)), df.spec)


class DropMissingOrNan(Step):
    """Drop rows whose x is null or NaN."""

    @describe("Drop rows without a value")
    @input({"x": {}})
    @output({"x": {}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        name = self.get_name("x")
        kept = df.where(quoted(name).isNotNull())
        return df._with(kept.where(~F.isnan(quoted(name))) if is_floating(df.dtype(name)) else kept, df.spec)


class FilterWithin(Step):
    """Keep rows whose x is one of the given values."""

    def __init__(self, within_values: Sequence):
        self.within_values = list(within_values)

    @describe("Keep rows with listed values")
    @input({"x": {}})
    @output({"x": {}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        return df._with(within(df.df, self.get_name("x"), self.within_values), df.spec)


def within(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    if len(values) <= LONG_LIST:
        return df.where(quoted(name).isin(list(values)))
    table = df.sparkSession.createDataFrame([(v,) for v in set(values) if v is not None], ["__value"])
    return df.join(table, quoted(name) == F.col("__value"), "left_semi")  # small tables are broadcast by size


class FilterRange(Step):
    """Keep rows whose x lies within bounds; rows without a value stay if ``keep_missing``."""

    def __init__(self, min: object, max: object, keep_missing: bool = False):  # noqa: A002
        self.min, self.max, self.keep_missing = min, max, keep_missing

    @describe("Keep rows within bounds")
    @input({"x": {}})
    @output({"x": {}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        x = quoted(self.get_name("x"))
        inside = x.between(F.lit(self.min), F.lit(self.max))
        return df._with(df.where(inside | x.isNull() if self.keep_missing else inside), df.spec)


def replace_out_of_range(column: Column, low: object, high: object, missing_value: object) -> Column:
    """Values beyond the bounds become the missing value; null stays null."""
    return F.when((column < F.lit(low)) | (column > F.lit(high)), F.lit(missing_value)).otherwise(column)


def long_groups(df: DataFrame, group: str, more_than: int) -> DataFrame:
    """Rows of groups with more than so many rows. Sizes are aggregated first, so that no group is collected."""
    sizes = df.groupBy(quoted(group).alias("__group")).agg(F.count("*").alias("__n")).where(F.col("__n") > more_than)
    return df.join(sizes, quoted(group).eqNullSafe(F.col("__group")), "left_semi")


# -- expressions -------------------------------------------------------------------------------------------------------

_EXPRESSION = re.compile(r"^\s*(.+?)\s*(==|!=|<>|<=|>=|=~|<|>)\s*(.+?)\s*$")
_DATETIME = re.compile(r"^datetime\(\s*['\"]?([^'\",]+)['\"]?\s*(?:,\s*['\"]?([^'\")]+)['\"]?\s*)?\)$")


def _literal(text: str) -> Column:
    if m := _DATETIME.match(text):
        stamp = F.lit(m[1].strip())
        return F.to_utc_timestamp(F.to_timestamp(stamp), F.lit(m[2].strip())) if m[2] else F.to_timestamp(stamp)
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return F.lit(text[1:-1])
    for kind in (int, float):
        try:
            return F.lit(kind(text))
        except ValueError:
            pass
    return F.lit({"true": True, "false": False}.get(text.lower(), text))


def parse_filter(text: str, columns: Sequence[str]) -> Column:
    """``column op value``: == != <> < > <= >=, =~ for a regular expression found anywhere, null (None) with == and !=,
    ``datetime(2024-01-01 00:00:00, UTC)`` for times. Nothing is evaluated."""
    m = _EXPRESSION.match(text)
    if m is None:
        raise ValueError(f"Filter: '{text}' is not of the form: column operator value")
    name, op, value = m.groups()
    if name not in columns:
        raise ValueError(f"Filter: no column '{name}'")
    x = quoted(name)
    if value in ("null", "None"):
        if op not in ("==", "!=", "<>"):
            raise ValueError(f"Filter: '{op}' does not go with null")
        return x.isNull() if op == "==" else x.isNotNull()
    if op == "=~":
        return x.rlike(value.strip("'\""))
    v = _literal(value)
    return {"==": x == v, "!=": x != v, "<>": x != v, "<": x < v, ">": x > v, "<=": x <= v, ">=": x >= v}[op]


def filter_by_expressions(df: DataFrame, expressions: Sequence[str]) -> DataFrame:
    """All expressions must hold; a malformed one is reported and skipped."""
    for text in expressions:
        try:
            df = df.where(parse_filter(text, df.columns))
        except ValueError as e:
            warnings.warn(str(e), stacklevel=2)
    return df
