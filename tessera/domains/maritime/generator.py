"""Seeded synthetic position messages, made by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.domains.maritime.data import COURSE_MAX, FISHING_TYPES, VESSEL_TYPES


def _uniform(seed: int, *parts: Column) -> Column:
    """In [0, 1), from a hash of the parts: independent of partitions, so reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(2**53))


def positions(spark: SparkSession, tracks: int, shortest: int = 25, longest: int = 300, seed: int = 0) -> DataFrame:
    """Tracks of random length: mmsi, lon, lat, date_time_utc (a tenth null), sog, cog, true_heading, nav_status, rot,
    message_nr (1 to 3), source (s or g)."""
    u = lambda k, *more: _uniform(seed * 1009 + k, F.col("track"), *more)
    t = spark.range(tracks).select(F.col("id").alias("track"))
    t = t.withColumns({
        "mmsi": (F.lit(200_000_000) + F.col("track") * 7919 % 599_999_999).cast("long"),
        "n": (F.lit(shortest) + F.floor(u(1) * (longest - shortest + 1))).cast("int"),
        "lon0": u(2) * 300 - 150,
        "lat0": u(3) * 140 - 70,
        "start": F.lit(1_640_995_200) + F.floor(u(4) * 365) * 86400,
    })
    m = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    i = F.col("i")
    steps = Window.partitionBy("track").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumns({
        "lon": F.col("lon0") + F.sum(u(5, i) - 0.5).over(steps) * 0.02,
        "lat": F.col("lat0") + F.sum(u(6, i) - 0.5).over(steps) * 0.02,
        "at": F.timestamp_seconds(F.col("start") + i * 60 + F.floor(u(7, i) * 30)),
    })
    return m.select(
        "mmsi", "lon", "lat",
        F.when(u(8, i) >= 0.1, F.date_format("at", "yyyy-MM-dd HH:mm:ss")).alias("date_time_utc"),
        (u(9, i) * 30).alias("sog"), (u(10, i) * COURSE_MAX).alias("cog"), (u(11, i) * COURSE_MAX).alias("true_heading"),
        F.floor(u(12, i) * 16).cast("long").alias("nav_status"), (u(13, i) * 40 - 20).alias("rot"),
        (F.floor(u(14, i) * 3) + 1).cast("long").alias("message_nr"),
        F.when(u(15, i) < 0.5, "s").otherwise("g").alias("source"),
    )


def _typed(messages: DataFrame, names: tuple[str, ...], column: str, seed: int) -> DataFrame:
    pick = F.floor(_uniform(seed, F.col("mmsi")) * len(names)).cast("int")
    return messages.select("mmsi").distinct().withColumn(column, F.get(F.array(*[F.lit(n) for n in names]), pick))


def vessel_types(messages: DataFrame, seed: int = 1) -> DataFrame:
    return _typed(messages, VESSEL_TYPES, "vessel_type", seed)


def fishing_types(messages: DataFrame, seed: int = 2) -> DataFrame:
    return _typed(messages, FISHING_TYPES, "fishing_type", seed)


def anchorages(spark: SparkSession, n: int, seed: int = 3) -> DataFrame:
    """s2id, latitude, longitude, label, sublabel, iso3."""
    u = lambda k: _uniform(seed * 1009 + k, F.col("id"))
    columns = [F.hex("id").alias("s2id"), (u(1) * 140 - 70).alias("latitude"), (u(2) * 360 - 180).alias("longitude")]
    return spark.range(n).select(*columns, F.concat(F.lit("anchorage "), "id").alias("label"), F.lit(None).cast("string").alias("sublabel"), F.lit("NOR").alias("iso3"))
