"""Streams of positions: deltas to the previous position of each group, across micro-batches.

Steps that look at one row only run on a streaming frame as they are. Those that look at the previous row need state: the
last position of each group, kept by Spark's state store and dropped after ``idle`` without new rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.geo import TRACK_RADIUS, great_circle_distance
from tessera.validation import quoted

_STATE = T.StructType([T.StructField("t", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


def with_previous(stream: DataFrame, group: str, time: str, lat: str, lon: str, delay: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """Each row with ``prev_time``, ``prev_lat`` and ``prev_lon``, null for a group's first; rows later than ``delay``
    behind the stream are dropped by the watermark. Rows of one micro-batch are put in order of time; a row that is older
    than the group's last one (but within the delay) is compared to the last one and does not replace it."""
    own = stream.withWatermark(time, delay)
    schema = T.StructType([*own.schema.fields, T.StructField("prev_time", T.TimestampType()), T.StructField("prev_lat", T.DoubleType()), T.StructField("prev_lon", T.DoubleType())])

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values(time, kind="stable")  # of one group and micro-batch
        last = state.get if state.exists else None
        times, prev = rows[time].astype("datetime64[us]").astype("int64"), []
        for t, y, x in zip(times, rows[lat], rows[lon], strict=True):
            prev.append(last)
            if last is None or t >= last[0]:
                last = (int(t), float(y), float(x))
        state.update(last)
        state.setTimeoutDuration(idle_ms)
        rows["prev_time"] = pd.to_datetime([p[0] if p else None for p in prev], unit="us")
        rows["prev_lat"], rows["prev_lon"] = [p[1] if p else None for p in prev], [p[2] if p else None for p in prev]
        yield rows

    return own.groupBy(quoted(group)).applyInPandasWithState(update, schema, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def deltas(stream: DataFrame, group: str, time: str, lat: str, lon: str, radius: float = TRACK_RADIUS, **options) -> DataFrame:
    """delta_time (s), delta_distance (km) and speed (km / h) of each row of a stream; null for a group's first."""
    rows = with_previous(stream, group, time, lat, lon, **options)
    seconds = (F.unix_micros(quoted(time).cast("timestamp")) - F.unix_micros("prev_time")) / F.lit(1e6)
    away = great_circle_distance(F.col("prev_lat"), F.col("prev_lon"), quoted(lat), quoted(lon), radius)
    made = rows.withColumns({"delta_time": seconds, "delta_distance": away})
    return made.withColumn("speed", F.try_divide("delta_distance", F.col("delta_time") / F.lit(3600.0))).drop("prev_time", "prev_lat", "prev_lon")


def activity(stream: DataFrame, group: str, time: str, width: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Rows per group and time window; late rows count until the watermark has passed the window."""
    frame = F.window(quoted(time), width, slide) if slide else F.window(quoted(time), width)
    counted = stream.withWatermark(time, delay).groupBy(quoted(group), frame).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(quoted(group), F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
