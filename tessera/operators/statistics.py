"""Aggregations beyond a single built-in."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.validation import quoted


#: Values that one task may order.
MOST_SORTED = 1_000_000


def quantile(df: DataFrame, column: str, p: float) -> float | None:
    """The exact p-quantile (interpolated) of the present values, in bounded memory.

    Approximate quantiles enclose the wanted rank; what lies below is counted and only what lies between is looked at
    again, until few rows are left or all that are left are equal. Numbers alone reach the driver.
    """
    x = quoted(column).cast("double")
    values = df.select(x.alias("x")).where("x is not null")
    n = values.count()
    if not n:
        return None
    at = p * (n - 1)
    low, high = (_ranked(values, int(k), n) for k in (math.floor(at), math.ceil(at)))
    return low + (high - low) * (at - math.floor(at))


def _ranked(values: DataFrame, rank: int, n: int) -> float:
    """The value at a place in the order, from 0. ``values``: n rows x."""
    while n > MOST_SORTED:
        share = rank / n
        low, high = values.agg(F.percentile_approx("x", [max(0.0, share - 1e-3), min(1.0, share + 1e-3)], 10_000)).first()[0]
        below, inside = values.agg(F.count_if(F.col("x") < low), F.count_if(F.col("x").between(low, high))).first()
        if not below <= rank < below + inside:  # the estimate was off: the part that has the rank
            values, rank, n = (values.where(F.col("x") < low), rank, below) if rank < below else (values.where(F.col("x") > high), rank - below - inside, n - below - inside)
            continue
        if low == high:
            return low
        if inside == n:  # many equal values at an end: leave them out
            equal = values.agg(F.count_if(F.col("x") == low)).first()[0]
            if rank < equal:
                return low
            values, rank, n = values.where(F.col("x") > low), rank - equal, n - equal
            continue
        values, rank, n = values.where(F.col("x").between(low, high)), rank - below, inside
    return values.orderBy("x").offset(rank).limit(1).first()[0]


def n_sigma(df: DataFrame, column: str, n: float) -> DataFrame:
    """Median plus n sample standard deviations, as one row ``n_sigma``."""
    median = quantile(df, column, 0.5)
    return df.agg((F.lit(median).cast("double") + F.lit(float(n)) * F.stddev_samp(quoted(column))).alias("n_sigma"))


def n_sigma_limited(df: DataFrame, column: str, n: float, p: float = 0.99) -> DataFrame:
    """The same over the values strictly below the p-quantile (interpolated)."""
    return n_sigma(df.where(quoted(column) < F.lit(quantile(df, column, p)).cast("double")), column, n)


def group_size(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(quoted(group)).agg(F.count(F.lit(1)).alias("size"))


def group_first(df: DataFrame, group: str, *order: str) -> DataFrame:
    """The first row of each group in a given order, by an aggregation that combines before the shuffle."""
    whole = F.struct(*[quoted(c) for c in df.columns])
    return df.groupBy(quoted(group).alias("__g")).agg(F.min_by(whole, F.struct(*[quoted(c) for c in order])).alias("__r")).select("__r.*")


def pooled_stats(df: DataFrame, column: str, group: str) -> DataFrame:
    """Mean, sample deviation and count of a column, pooled from statistics of its groups."""
    x = quoted(column)
    each = df.groupBy(quoted(group)).agg(F.avg(x).alias("m"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("v"), F.count(x).alias("n"))
    total = each.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum((F.col("n") - 1) * F.col("v") + F.col("n") * F.col("m") ** 2).alias("q"))
    mean = F.try_divide(F.col("s"), F.col("n"))
    variance = F.try_divide(F.col("q") - F.col("n") * mean * mean, F.col("n") - 1)
    return total.select(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), variance)).alias("stddev"), F.col("n").alias("total_count"))


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """bin (0 to bins - 1), its lower edge and the count of values; values beyond the bounds are left out."""
    x = quoted(column).cast("double")
    step = (high - low) / bins
    inside = df.where((x >= low) & (x <= high))
    number = F.least(F.floor((x - F.lit(low)) / F.lit(step)), F.lit(bins - 1)).cast("int")
    return inside.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("edge", F.lit(low) + F.col("bin") * F.lit(step))


def density_grid(df: DataFrame, lat: str, lon: str, cell: float = 1.0) -> DataFrame:
    """Positions per grid cell: what a map of many positions shows, aggregated before anything is drawn."""
    corner = lambda c: F.floor(quoted(c) / F.lit(cell)) * F.lit(cell)
    return df.groupBy(corner(lat).alias("lat"), corner(lon).alias("lon")).agg(F.count(F.lit(1)).alias("n"))
