"""CSV with several spellings of null, a separator found on the header line, and types inferred from all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.validation import quoted

# Texts that mean null.
NULLS = ("None", "none", "Null", "null")
_INTEGER, _FLOAT, _BOOLEAN = r"^\s*[+-]?\d{1,19}\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(NaN|nan|inf|Infinity)\s*$", r"^\s*(true|false)\s*$"


def _raw(spark: SparkSession, paths: list[str], sep: str, multi_line: bool = False) -> DataFrame:
    return spark.read.csv(paths, sep=sep, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line, enforceSchema=False)


def quoted_breaks(spark: SparkSession, paths: list[str]) -> bool:
    """Whether a quoted value goes on in the next line: then some line has an odd number of quotes. One scan of the text."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return bool(spark.read.text(paths).agg(F.bool_or(quotes % 2 == 1)).first()[0])


def separator(spark: SparkSession, paths: list[str]) -> str:
    """";" unless that leaves a single column and "," does not. Spark's reader looks at the header, quotes included."""
    if len(_raw(spark, paths[:1], ";").columns) > 1:
        return ";"
    return "," if len(_raw(spark, paths[:1], ",").columns) > 1 else ";"


def read_csv(spark: SparkSession, paths: list[str], sep: str | None = None, infer: bool = True) -> DataFrame:
    """Null spellings become null; then types: one aggregation over all rows decides for every column at once.

    A file is read in one piece only if it has line breaks inside of quotes; any other is split.
    """
    raw = _raw(spark, paths, sep or separator(spark, paths), quoted_breaks(spark, paths))
    clean = raw.select(*[F.when(~quoted(c).isin(*NULLS), quoted(c)).alias(c) for c in raw.columns])
    return with_types(clean) if infer else clean


def with_types(df: DataFrame) -> DataFrame:
    """Text columns as integers, floats or booleans where every value that is not null can be read so."""
    if not df.columns:
        return df
    fits = lambda c, pattern: F.coalesce(F.bool_and(quoted(c).rlike(pattern)), F.lit(False))
    whole = lambda c: fits(c, _INTEGER) & F.coalesce(F.bool_and(F.trim(quoted(c)).try_cast("long").isNotNull() | quoted(c).isNull()), F.lit(False))
    row = df.agg(*[F.struct(whole(c).alias("i"), fits(c, _FLOAT).alias("f"), fits(c, _BOOLEAN).alias("b")).alias(f"c{k}") for k, c in enumerate(df.columns)]).first()

    def typed(k: int, name: str) -> Column:
        kind = T.LongType() if row[k]["i"] else T.DoubleType() if row[k]["f"] else T.BooleanType() if row[k]["b"] else None
        return (F.trim(quoted(name)).cast(kind) if kind is not None else quoted(name)).alias(name)

    return df.select(*[typed(k, c) for k, c in enumerate(df.columns)])


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", "null").csv(path)
