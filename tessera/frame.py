"""A Spark DataFrame and the specification of its columns, kept together."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import validation
from tessera.model.annotations import HISTORY, Change, History
from tessera.model.spec import ColumnSpec, FrameSpec, Merge, Mode


class AnnotatedFrame:
    """Validates by mode on construction. Everything that a DataFrame offers is forwarded; ``df["c"]`` is one column.

    The wrapper owns the specification and writes it into the fields' metadata, where Spark carries it through filters,
    joins and Parquet files.
    """

    def __init__(self, df: DataFrame | AnnotatedFrame, spec: FrameSpec | None = None, mode: Mode = Mode.READONLY, strict_types: bool = True):
        if isinstance(df, AnnotatedFrame):
            spec, df = spec or df.spec, df.df
        if not hasattr(df, "sparkSession") or not hasattr(df, "schema"):
            raise ValueError(f"AnnotatedFrame: a DataFrame is needed, got {type(df).__name__}")
        if spec is None:
            spec = FrameSpec.from_schema(df.schema)
        self._df, self.spec = validation.apply(df, spec, mode, strict_types)

    # -- access --------------------------------------------------------------------------------------------------------

    @property
    def df(self) -> DataFrame:
        return self._df

    @property
    def annotated(self) -> DataFrame:
        """The DataFrame with the specification in its fields' metadata."""
        out = self._df
        for c in self.spec.columns:
            if c.name in out.columns:
                out = out.withMetadata(c.name, c.to_field_metadata())
        return out

    @property
    def column_names(self) -> list[str]:
        return self._df.columns

    def __contains__(self, name: str) -> bool:
        return name in self._df.columns

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._df.columns:
            raise KeyError(f"AnnotatedFrame: no column '{name}'")
        return self._df.select(validation.quoted(name))

    def __setitem__(self, name: str, value: Column) -> None:
        if not isinstance(value, Column):
            raise ValueError("AnnotatedFrame: a Column is needed; values by position have no place in a distributed frame")
        self._df = self._df.withColumn(name, value)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name in self._df.columns and not hasattr(DataFrame, name):
            return self[name]
        return getattr(self._df, name)

    @property
    def shape(self) -> tuple[int, int]:
        return self._df.count(), len(self._df.columns)

    def dtype(self, name: str):
        return self._df.schema[name].dataType

    def set_dtype(self, name: str, kind: object) -> AnnotatedFrame:
        from tessera.model.types import resolve

        if name not in self._df.columns:
            raise KeyError(f"AnnotatedFrame: no column '{name}'")
        return self._with(self._df.withColumn(name, validation.quoted(name).cast(resolve(kind))), self.spec)

    def minmax(self, name: str) -> tuple:
        return validation.minmax(self._df, name)

    def categories(self, name: str, most: int = validation.MOST_CATEGORIES) -> list | None:
        return validation.categories(self._df, name, most)

    def stats(self, name: str):
        return validation.column_stats(self._df, name)

    def null_count(self) -> DataFrame:
        return self._df.select(*[F.count_if(validation.quoted(c).isNull()).alias(c) for c in self._df.columns])

    def equals(self, other: AnnotatedFrame | DataFrame) -> bool:
        """The same rows, as often; order does not count."""
        theirs = other.df if isinstance(other, AnnotatedFrame) else other
        if self._df.dtypes != theirs.dtypes:
            return False
        return self._df.exceptAll(theirs).isEmpty() and theirs.exceptAll(self._df).isEmpty()

    # -- transformations -----------------------------------------------------------------------------------------------

    def _with(self, df: DataFrame, spec: FrameSpec) -> AnnotatedFrame:
        out = object.__new__(AnnotatedFrame)
        out._df, out.spec = df, spec
        return out

    def copy(self) -> AnnotatedFrame:
        """Frames are immutable, so only the specification is copied."""
        return self._with(self._df, FrameSpec.from_dict(self.spec.to_dict()))

    def drop(self, *names: str, strict: bool = True) -> AnnotatedFrame:
        return self._with(self._df.drop(*names), self.spec.drop(names, strict))

    def rename(self, names: dict[str, str]) -> AnnotatedFrame:
        return self._with(self._df.withColumnsRenamed(names), self.spec.renamed(names))

    def head(self, n: int = 10) -> DataFrame:
        return self._df.limit(n)

    def unique(self, *names: str) -> DataFrame:
        return (self._df.select(*names) if names else self._df).distinct()

    def drop_nulls(self, *names: str) -> DataFrame:
        out = self._df
        for name in names or self._df.columns:
            out = out.where(validation.quoted(name).isNotNull())
        return out

    def drop_nans(self, *names: str) -> DataFrame:
        from tessera.model.types import is_floating

        out = self._df
        for name in names or self._df.columns:
            if is_floating(self.dtype(name)):
                out = out.where(~F.isnan(validation.quoted(name)) | validation.quoted(name).isNull())
        return out

    def join_suffixed(self, other: DataFrame, left_on: Sequence[str], right_on: Sequence[str], how: str = "inner", suffix: str = "_right") -> DataFrame:
        """Equi-join in which right columns that clash get a suffix and right keys go."""
        right = other.select(*[validation.quoted(c).alias(c + suffix if c in self._df.columns else c) for c in other.columns])
        keys = [c + suffix if c in self._df.columns else c for c in right_on]
        condition = [self._df[a] == right[b] for a, b in zip(left_on, keys, strict=True)]
        return self._df.join(right, condition, how).drop(*keys)

    def join_where(self, other: AnnotatedFrame | DataFrame, *predicates: Column, within: tuple[str, str, float, float] | None = None, suffix: str = "_right") -> DataFrame:
        """Pairs for which every predicate holds; right columns that clash get a suffix, and predicates name columns of the result.

        Spark makes an equi-join of predicates with an equality. For ranges alone it would compare all pairs:
        ``within=(left, right, before, after)`` keeps pairs with right in [left - before, left + after], as an equi-join on buckets.
        """
        from tessera.operators.joins import interval_join

        if not predicates and within is None:
            raise ValueError("AnnotatedFrame: join_where needs a predicate")
        theirs = other.df if isinstance(other, AnnotatedFrame) else other
        right = theirs.select(*[validation.quoted(c).alias(c + suffix if c in self._df.columns else c) for c in theirs.columns])
        condition = reduce(Column.__and__, predicates) if predicates else None
        if within is None:
            return self._df.join(right, condition)
        left_on, right_on, before, after = within
        key = right_on + suffix if right_on in self._df.columns else right_on
        return interval_join(self._df, right, validation.quoted(left_on), validation.quoted(key), before, after, condition)

    def validate(self, mode: Mode = Mode.READONLY, **options: bool) -> AnnotatedFrame:
        return self._with(*validation.apply(self._df, self.spec, mode, **options))

    def updated(self, df: DataFrame, output: FrameSpec) -> AnnotatedFrame:
        """This frame after a step: new columns are appended, ranges and statistics of changed ones replaced or cleared."""
        spec = self.spec.select(df.columns)
        for c in output.columns:
            if c.name not in df.columns:
                raise ValueError(f"AnnotatedFrame: output column '{c.name}' is not in the data")
            if old := spec.get(c.name):
                fresh = {"value_range": c.value_range, "value_stats": c.value_stats}
                declared = {k: getattr(c, k) for k in c.__dataclass_fields__ if k not in ("name", "is_optional", *fresh) and getattr(c, k) not in (None, {})}
                meanings = {} if c.value_range is None and "value_meanings" not in declared else declared.get("value_meanings", old.value_meanings)
                spec = spec.with_columns(old.but(**{**declared, **fresh, "value_meanings": meanings}))
            else:
                spec = spec.with_columns(c)
        kinds = {f.name: f.dataType for f in df.schema}
        missing = [ColumnSpec(n, representation_type=kinds[n]) for n in df.columns if n not in spec]
        return self._with(df, spec.with_columns(*missing))

    def add_change(self, title: str, description: str = "", at: dt.datetime | None = None) -> AnnotatedFrame:
        change = Change(title, description, at) if at is not None else Change(title, description)
        history = self.spec.annotations.get(HISTORY)
        return self._with(self._df, self.spec.add_annotation(History([*(history.changes if history else []), change])))

    # -- sources -------------------------------------------------------------------------------------------------------

    @staticmethod
    def from_dict(spark, data: dict[str, Sequence], **options) -> AnnotatedFrame:
        """From columns of values on the driver."""
        import pandas as pd

        return AnnotatedFrame.from_pandas(spark, pd.DataFrame(data), **options)

    @staticmethod
    def from_pandas(spark, data, spec: FrameSpec | None = None, mode: Mode = Mode.IGNORE) -> AnnotatedFrame:
        """From a pandas frame on the driver; without a specification it is inferred."""
        df = spark.createDataFrame(data)
        return AnnotatedFrame(df, spec if spec is not None else validation.infer(df), mode)

    @staticmethod
    def from_files(spark, files: Sequence[str | Path], metadata_required: bool = True, mode: Mode = Mode.READONLY, strategy: Merge = Merge.THIS) -> AnnotatedFrame:
        from tessera.sources.readers import load

        return load(spark, files, metadata_required, mode, strategy)

    @staticmethod
    def from_file(spark, file: str | Path, **options) -> AnnotatedFrame:
        return AnnotatedFrame.from_files(spark, [file], **options)

    def save(self, path: str | Path) -> None:
        from tessera.sources.writers import save

        save(self, path)

    def export(self, path: str | Path, single_file: bool = False) -> None:
        from tessera.sources.writers import export

        export(self, path, single_file)
