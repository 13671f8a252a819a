"""Checking data against specifications, and learning specifications from data. One job per check, whatever the columns."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.model import types as types_
from tessera.model.ranges import ListOfValues, MinMax
from tessera.model.spec import ColumnSpec, FrameSpec, Mode
from tessera.model.stats import ColumnStats

MOST_CATEGORIES = 100
_TIME = re.compile(r"\d\d:\d\d")


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _ordinal(column: Column, kind: T.DataType) -> Column:
    """A number for mean and deviation: times as epoch seconds."""
    if isinstance(kind, types_.TEMPORAL):
        return F.unix_micros(column.cast("timestamp")) / F.lit(1e6)
    return column.cast("double")


def present(column: Column, kind: T.DataType) -> Column:
    """The column without NaN, which Spark would order above every number."""
    return F.when(~F.isnan(column), column) if types_.is_floating(kind) else column


def statistics(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """min, max, mean, stddev, total_count (non-null), null_count of many columns from one aggregation."""
    if not columns:
        return {}
    kinds = {f.name: f.dataType for f in df.schema}
    aggs = []
    for k, name in enumerate(columns):
        c = present(quoted(name), kinds[name])
        number = _ordinal(c, kinds[name]) if isinstance(kinds[name], (*types_.NUMERIC, *types_.TEMPORAL)) else F.lit(None).cast("double")
        aggs += [
            F.min(c).alias(f"min{k}"),
            F.max(c).alias(f"max{k}"),
            F.avg(number).alias(f"mean{k}"),
            F.stddev_samp(number).alias(f"stddev{k}"),
            F.count(quoted(name)).alias(f"total_count{k}"),
            F.count_if(quoted(name).isNull()).alias(f"null_count{k}"),
        ]
    row = df.agg(*aggs).first()
    keys = ("min", "max", "mean", "stddev", "total_count", "null_count")
    return {name: {key: row[f"{key}{k}"] for key in keys} for k, name in enumerate(columns)}


def minmax(df: DataFrame, column: str) -> tuple:
    s = statistics(df, [column])[column]
    return s["min"], s["max"]


def column_stats(df: DataFrame, column: str) -> ColumnStats | None:
    return _as_stats(statistics(df, [column])[column])


def _as_stats(s: dict) -> ColumnStats | None:
    if s["mean"] is None or s["stddev"] is None:
        return None
    return ColumnStats(s["mean"], s["stddev"], s["total_count"], s["null_count"])


def categories(df: DataFrame, column: str, most: int = MOST_CATEGORIES) -> list | None:
    """Sorted distinct values, null last, if there are ``most`` at most and they do not look like times of day.

    What reaches the driver is bounded by ``most`` + 1 rows.
    """
    rows = [r[0] for r in df.select(quoted(column).alias("c")).distinct().orderBy(F.asc_nulls_last("c")).limit(most + 1).collect()]
    if len(rows) > most or sum(bool(_TIME.search(str(v))) for v in rows[:10] if v is not None) >= 3:
        return None
    return rows


def infer(df: DataFrame, columns: Sequence[str] | None = None, known: FrameSpec | None = None) -> FrameSpec:
    """A specification from data: categories or bounds of strings, bounds and statistics of numbers and times."""
    names = list(columns if columns is not None else df.columns)
    kinds = {f.name: f.dataType for f in df.schema}
    orderable = [n for n in names if isinstance(kinds[n], (*types_.NUMERIC, *types_.TEMPORAL, T.StringType, T.BooleanType))]
    stats = statistics(df, orderable)
    specs = []
    for name in names:
        old = known.get(name) if known is not None else None
        spec = old or ColumnSpec(name)
        spec = spec.but(representation_type=spec.representation_type or kinds[name])
        values = categories(df, name) if types_.is_string(kinds[name]) else None
        s = stats.get(name)
        if values is not None:
            spec = spec.but(value_range=ListOfValues(values))
        elif s is not None and s["min"] is not None and not isinstance(kinds[name], T.BooleanType):
            spec = spec.but(value_range=MinMax(s["min"], s["max"]))
        if s is not None and not types_.is_string(kinds[name]):
            spec = spec.but(value_stats=_as_stats(s))
        specs.append(spec)
    return FrameSpec(specs, known.annotations if known is not None else ())


def _check_names(df: DataFrame, spec: FrameSpec, mode: Mode) -> None:
    for c in spec.columns:
        if c.name not in df.columns:
            raise ValueError(f"Missing column '{c.name}' in the data")
    if mode is not Mode.IGNORE:
        for name in df.columns:
            if name not in spec:
                raise ValueError(f"Missing specification of column '{name}'")


def violations(df: DataFrame, spec: FrameSpec, membership: bool = False) -> dict[str, str]:
    """Columns whose values lie outside of their range, from a single aggregation.

    Bounds are checked for present values (a column's minimum and maximum must be inside). ``membership`` also checks lists
    value by value; without it, lists are taken on trust.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    checks, names = [], []
    for c in spec.columns:
        column = quoted(c.name)
        if isinstance(c.value_range, MinMax):
            slack = c.value_range._slack
            low, high = (c.value_range.min - slack, c.value_range.max + slack) if slack else (c.value_range.min, c.value_range.max)
            value = present(column, kinds[c.name])
            checks.append(F.count_if((value < F.lit(low)) | (value > F.lit(high))))
            names.append(c)
        elif isinstance(c.value_range, ListOfValues) and membership:
            checks.append(F.count_if(~c.value_range.predicate(column)))
            names.append(c)
    if not checks:
        return {}
    row = df.agg(*[x.alias(f"v{k}") for k, x in enumerate(checks)]).first()
    return {c.name: f"{n} values lie outside of range {c.value_range}" for c, n in zip(names, row, strict=True) if n}


def type_errors(df: DataFrame, spec: FrameSpec, strict: bool = True) -> dict[str, str]:
    kinds = {f.name: f.dataType for f in df.schema}
    bad = [c for c in spec.columns if c.representation_type is not None and not types_.matches(kinds[c.name], c.representation_type, strict)]
    return {c.name: f"is {kinds[c.name].simpleString()}, not {c.representation_type.simpleString()}" for c in bad}


def corrected(df: DataFrame, spec: FrameSpec) -> DataFrame:
    """The data made to fit: types cast, values out of bounds replaced by the missing value or their rows dropped. Lazy."""
    kinds = {f.name: f.dataType for f in df.schema}
    casts = {}
    for c in spec.columns:
        if c.representation_type is not None and not types_.matches(kinds[c.name], c.representation_type):
            warnings.warn(f"Column '{c.name}' is {kinds[c.name].simpleString()} and is cast to {c.representation_type.simpleString()}", stacklevel=3)
            casts[c.name] = quoted(c.name).cast(c.representation_type)
    df = df.withColumns(casts) if casts else df
    replaced, conditions = {}, []
    for c in spec.columns:
        if not isinstance(c.value_range, MinMax):
            continue
        column = quoted(c.name)
        if c.missing_value is None:
            conditions.append(c.value_range.predicate(column))
        else:
            replaced[c.name] = F.when(c.value_range.outside(column), F.lit(c.missing_value)).otherwise(column)
    for condition in conditions:
        df = df.where(condition)
    return df.withColumns(replaced) if replaced else df


def apply(df: DataFrame, spec: FrameSpec, mode: Mode, strict_types: bool = True, membership: bool = False) -> tuple[DataFrame, FrameSpec]:
    """Data and specification after the mode has been applied; see ``Mode``."""
    mode = Mode(mode)
    _check_names(df, spec, mode)
    if mode is Mode.READONLY:
        problems = type_errors(df, spec, strict_types) | violations(df, spec, membership)
        if problems:
            raise ValueError("; ".join(f"Column '{n}' {what}" if what.startswith("is ") else f"Column '{n}': {what}" for n, what in problems.items()))
    elif mode is Mode.UPDATE_DATA:
        df = corrected(df, spec)
    elif mode is Mode.UPDATE_METADATA:
        spec = infer(df, spec.column_names, spec)
    return df, spec
