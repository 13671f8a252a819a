"""Sliding windows for forecasting, random windows, and splits of groups."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.validation import quoted


def sequences(df: DataFrame, order: Sequence[str], features: Sequence[str], length: int, horizon: int = 0, targets: Sequence[str] | None = None, group: str | None = None) -> DataFrame:
    """Every window of ``length`` consecutive rows: group, ``start`` (0-based) and X, an array of feature structs.

    With a ``horizon`` also y, the targets of the rows that follow; only windows that are complete are kept, so a
    sequence of n rows has n - length - horizon + 1 of them. Frames are row frames over one sorted partition.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    if len({kinds[f] for f in features}) > 1:
        raise ValueError(f"sequences: features have different types: {[(f, kinds[f].simpleString()) for f in features]}")
    by = Window.partitionBy(quoted(group)) if group else Window.partitionBy(F.lit(0))
    w = by.orderBy(*[quoted(c) for c in order])
    pack = lambda names: F.struct(*[quoted(c) for c in names])
    # One projection: names of the result may equal those of features.
    made = [(F.row_number().over(w).cast("long") - 1).alias("start"), F.collect_list(pack(features)).over(w.rowsBetween(0, length - 1)).alias("X")]
    condition = F.size("X") == length
    if horizon:
        made.append(F.collect_list(pack(targets or features)).over(w.rowsBetween(length, length + horizon - 1)).alias("y"))
        condition = condition & (F.size("y") == horizon)
    return df.select(*([quoted(group)] if group else []), *made).where(condition)


def random_sequences(df: DataFrame, group: str, order: Sequence[str], features: Sequence[str], length: int, horizon: int = 0, targets: Sequence[str] | None = None, batch: int = 64, seed: int = 0) -> DataFrame:
    """``batch`` random windows of random groups that are long enough; an error if there is none."""
    # Keys are drawn from the sizes of the groups: ``batch`` of each group at most, then of all; only their groups get windows.
    sizes = df.groupBy(quoted(group).alias("__g")).agg((F.count(F.lit(1)) - (length + horizon)).alias("__last")).where("__last >= 0")
    keys = sizes.select("__g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last"))).alias("__start"))
    keys = F.broadcast(keys.orderBy(F.xxhash64("__g", "__start", F.lit(seed)), "__g", "__start").limit(batch))  # ``batch`` rows
    some = df.join(keys.select("__g").distinct(), quoted(group).eqNullSafe(F.col("__g")), "left_semi")
    found = sequences(some, order, features, length, horizon, targets, group)
    picked = found.join(keys, found[group].eqNullSafe(F.col("__g")) & (F.col("start") == F.col("__start")), "left_semi")
    if picked.isEmpty():
        raise RuntimeError(f"random_sequences: no group has {length + horizon} rows")
    return picked


def to_arrays(windows: DataFrame) -> Iterator[tuple]:
    """Windows as numpy arrays (length x features), partition by partition: the hand-over to a trainer."""
    import numpy as np

    for row in windows.toLocalIterator(prefetchPartitions=True):
        x = np.array([tuple(r) for r in row["X"]])
        yield (x, np.array([tuple(r) for r in row["y"]])) if "y" in windows.columns else (x,)


def largest_remainder(n: int, ratios: Sequence[float]) -> list[int]:
    """n in whole parts in proportion to the ratios; the parts add up to n."""
    exact = [n * r / sum(ratios) for r in ratios]
    parts = [math.floor(x) for x in exact]
    for k in sorted(range(len(ratios)), key=lambda k: (parts[k] - exact[k], k))[: n - sum(parts)]:
        parts[k] += 1
    return parts


def split_groups(df: DataFrame, group: str, ratios: Sequence[float], seed: int = 0) -> list[DataFrame]:
    """Disjoint parts by group, in proportion to the ratios.

    Groups are put in an order of hashes, not of ``rand``, so that the split does not depend on partitions. Places in the
    order come from counts of hash ranges, so groups are not sorted in one task.
    """
    if any(r < 0 for r in ratios) or sum(ratios) <= 0:
        raise ValueError("split_groups: ratios must be positive")
    key = F.xxhash64(quoted(group), F.lit(seed))
    groups = df.select(quoted(group).alias("__g")).distinct().withColumn("__h", F.xxhash64("__g", F.lit(seed)))
    groups = groups.withColumn("__range", F.shiftright("__h", 52).cast("int"))  # 4096 ranges, in order of the hash
    counts = {r[0]: r[1] for r in groups.groupBy("__range").count().collect()}
    cuts, place = [], 0
    for part in largest_remainder(sum(counts.values()), ratios)[:-1]:
        place += part
        cuts.append(place)
    bounds = [_hash_at(groups, counts, cut) for cut in cuts]
    out, low = [], None
    for high in [*bounds, None]:
        part = df
        if low is not None:
            part = part.where(key >= F.lit(low))
        if high is not None:
            part = part.where(key < F.lit(high))
        out.append(part)
        low = high if high is not None else low
    return out


def _hash_at(groups: DataFrame, counts: dict[int, int], cut: int) -> int:
    """The hash of the group at a place in the order; one range is looked at."""
    at = 0
    for number in sorted(counts):
        if at + counts[number] > cut:
            rows = groups.where(F.col("__range") == number).select("__h").orderBy("__h").offset(cut - at).limit(1).collect()
            return rows[0][0]
        at += counts[number]
    return 2**63 - 1


def train_test_validate(df: DataFrame, group: str, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 0) -> dict[str, DataFrame]:
    return dict(zip(("train", "test", "validate"), split_groups(df, group, ratios, seed), strict=True))


def shuffled(df: DataFrame, seed: int = 0, fraction: float = 1.0) -> DataFrame:
    """Rows in an order of hashes that depends on the seed and not on partitions; a fraction keeps about that share."""
    kept = df if fraction >= 1 else df.sample(fraction=fraction, seed=seed)
    return kept.orderBy(F.xxhash64(*[quoted(c) for c in kept.columns], F.lit(seed)))
