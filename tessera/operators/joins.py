"""Joins: lookups, joins on equal times, interval joins with a distance, nearest points."""

from __future__ import annotations

import math
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.frame import AnnotatedFrame
from tessera.functions import geo, scalar, sphere
from tessera.model.types import INTEGRAL, is_string
from tessera.plans.step import Step, describe, input, output
from tessera.validation import quoted

#: Points whose coordinates go into the plan as literals; more are joined as a table.
MOST_LITERAL_POINTS = 500


class JoinHow(str, Enum):
    INNER = "inner"
    LEFT = "left"
    RIGHT = "right"
    FULL = "full"
    SEMI = "left_semi"
    ANTI = "left_anti"
    CROSS = "cross"


def join_column(df: DataFrame, on: str, dataset: DataFrame, right_on: str, column: str, out: str, how: JoinHow = JoinHow.LEFT) -> DataFrame:
    """``df`` joined with one column of ``dataset``; the right key does not stay. Right duplicates multiply rows.

    A right or full join keeps the key of rows that only the right side has. Spark broadcasts the small side by its size.
    """
    how = JoinHow(how)
    right = dataset.select(quoted(right_on).alias("__key"), quoted(column).alias("__added"))
    if how is JoinHow.CROSS:
        return df.crossJoin(right.select(F.col("__added").alias(out)))
    condition = quoted(on) == F.col("__key")
    if how in (JoinHow.SEMI, JoinHow.ANTI):
        return df.join(right, condition, how.value)
    joined = df.join(right, condition, how.value)
    if how in (JoinHow.RIGHT, JoinHow.FULL):
        joined = joined.withColumn(on, F.coalesce(quoted(on), F.col("__key")))
    return joined.drop("__key").withColumnRenamed("__added", out)


class JoinDataFrameByColumn(Step):
    """Add an integer column of another dataset by an equi-join on x."""

    def __init__(self, dataset: DataFrame | AnnotatedFrame | str, right_on: str, dataset_column: str, how: str = "left", sep: str = ";"):
        self.dataset, self.right_on, self.dataset_column, self.how, self.sep = dataset, right_on, dataset_column, JoinHow(how).value, sep
        if not isinstance(dataset, str):
            self._check(dataset)

    def _check(self, dataset: DataFrame) -> None:
        for name in (self.right_on, self.dataset_column):
            if name not in dataset.columns:
                raise KeyError(f"{type(self).__name__}: the dataset has no column '{name}'")
        if not isinstance(dataset.schema[self.dataset_column].dataType, INTEGRAL):
            raise ValueError(f"{type(self).__name__}: '{self.dataset_column}' must be an integer column")

    def _table(self, df: AnnotatedFrame) -> DataFrame:
        data = self.dataset
        if isinstance(data, str):
            from tessera.sources.readers import read

            data = read(df.df.sparkSession, data, self.sep)
        return data.df if isinstance(data, AnnotatedFrame) else data

    @describe("Join a column of another dataset")
    @input({"x": {}})
    @output({"out": {"is_optional": True}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        table = self._table(df)
        self._check(table)
        joined = join_column(df.df, self.get_name("x"), table, self.right_on, self.dataset_column, self.get_name("out"), self.how)
        return df._with(joined, df.spec)


class MappedLookupJoin(JoinDataFrameByColumn):
    """Like its base; a text column is first mapped to ids, and a text without an id is an error of the query."""

    mapping: dict[str, int] = {}

    def _check(self, dataset: DataFrame) -> None:
        for name in (self.right_on, self.dataset_column):
            if name not in dataset.columns:
                raise KeyError(f"{type(self).__name__}: the dataset has no column '{name}'")
        kind = dataset.schema[self.dataset_column].dataType
        if not is_string(kind) and not isinstance(kind, INTEGRAL):
            raise ValueError(f"{type(self).__name__}: '{self.dataset_column}' must hold names or ids")

    def _table(self, df: AnnotatedFrame) -> DataFrame:
        data = super()._table(df)
        if self.dataset_column in data.columns and is_string(data.schema[self.dataset_column].dataType):
            mapped = scalar.strict_lookup(quoted(self.dataset_column), self.mapping, self.dataset_column)
            return data.withColumn(self.dataset_column, mapped.cast("long"))
        return data


class JoinByTimestamp(Step):
    """Inner join of two frames on equal times; the right time does not stay, clashing right columns get a suffix."""

    def __init__(self, suffix: str = "_other"):
        self.suffix = suffix

    @describe("Join on equal times")
    @input({"timestamp": {}})
    @input({"timestamp": {}}, label="other")
    @output({})
    def transform(self, df: AnnotatedFrame, other: AnnotatedFrame) -> AnnotatedFrame:
        left, right = self.get_name("timestamp"), self.get_name("timestamp", "other")
        joined = df.join_suffixed(other.df, [left], [right], "inner", self.suffix)
        names = {c: c + self.suffix for c in other.column_names if c in df.column_names}
        return df._with(joined, df.spec.merge(other.spec.drop([right]).renamed(names)).select(joined.columns))


def _meetings(
    left: DataFrame,
    right: DataFrame,
    left_time: Column,
    right_time: Column,
    before: float,
    after: float,
    condition: Column | None = None,
    cells: tuple[Column, Column] | None = None,
    how: str = "inner",
) -> DataFrame:
    """``interval_join`` with its helper columns: the times as seconds are ``__t1`` and ``__t2``."""
    width = float(before + after) or 1.0
    bucket = lambda t: F.floor(t / F.lit(width))
    a = left.withColumn("__t1", left_time.cast("double"))
    b = right.withColumn("__t2", right_time.cast("double")).withColumn("__c", bucket(F.col("__t2")))
    exact = (F.col("__b") == F.col("__c")) & (F.col("__t1") - before <= F.col("__t2")) & (F.col("__t1") + after >= F.col("__t2"))
    if cells is not None:
        a, b = a.withColumn("__x", F.explode(cells[0])), b.withColumn("__y", cells[1])
        exact = (F.col("__x") == F.col("__y")) & exact
    a = a.withColumn("__b", F.explode(F.sequence(bucket(F.col("__t1") - before), bucket(F.col("__t1") + after))))
    return a.join(b, exact if condition is None else exact & condition, how)


def interval_join(
    left: DataFrame,
    right: DataFrame,
    left_time: Column,
    right_time: Column,
    before: float,
    after: float,
    condition: Column | None = None,
    cells: tuple[Column, Column] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Pairs with right_time in [left_time - before, left_time + after], times and widths in seconds as numbers.

    Time is cut into buckets as wide as the interval; a left row looks into the two buckets that its interval can touch,
    a right row sits in one. So this is an equi-join that shuffles by bucket, without pairs that are far apart.
    ``cells`` adds space to the key: the cells a left row looks into (an array) and the one a right row sits in. The pairs
    are then those whose cells meet as well, and one stretch of time is spread over as many keys as there are cells.
    ``how="right"`` keeps right rows without a pair: a right row is under one key, so the join itself finds them.
    """
    if how not in ("inner", "right"):
        raise ValueError("interval_join: a left row is under several keys, so only inner and right joins can be had")
    joined = _meetings(left, right, left_time, right_time, before, after, condition, cells, how)
    return joined.drop("__b", "__c", "__t1", "__t2", "__x", "__y")


class JoinByIntervalAndDistance(Step):
    """Events of the other frame near a position in time and space, joined to it; positions without events stay.

    Adds ``delta_distance`` (km) and ``delta_time`` (s, event minus position).
    """

    def __init__(self, before: float, after: float, distance_km: float, radius: float = geo.EARTH_RADIUS):
        self.before, self.after, self.distance_km, self.radius = before, after, distance_km, radius

    @describe("Join events near in time and space")
    @input({"id": {}, "time": {}, "lat": {"unit": "deg"}, "lon": {"unit": "deg"}})
    @input({"time": {}, "lat": {"unit": "deg"}, "lon": {"unit": "deg"}}, label="other")
    @output({"delta_distance": {"unit": "km"}, "delta_time": {"unit": "s"}})
    def transform(self, df: AnnotatedFrame, other: AnnotatedFrame) -> AnnotatedFrame:
        mine, theirs = self.get_name, lambda n: self.get_name(n, "other")
        names = {c: f"{c}_other" if c in df.column_names else c for c in other.column_names}
        places, events = (x.df.withColumnsRenamed({c: f"{mark}{c}" for c in x.column_names}) for x, mark in ((df, "__l_"), (other, "__e_")))
        l, e = (lambda n: quoted(f"__l_{mine(n)}")), (lambda n: quoted(f"__e_{theirs(n)}"))
        away = geo.great_circle_distance(l("lat"), l("lon"), e("lat"), e("lon"), self.radius)
        seconds = lambda c, kind: c.cast("double") if isinstance(kind, T.NumericType) else scalar.micros(c) / F.lit(1e6)
        t1, t2 = seconds(l("time"), df.dtype(mine("time"))), seconds(e("time"), other.dtype(theirs("time")))
        # An event looks for the positions around it. A position is under one key, so the outer join is one join, and
        # pairs, of which there may be far more than rows, are neither shuffled nor joined back to the positions.
        angle = self.distance_km / self.radius
        chord = max(sphere.chord(angle) + 1e-12, 1e-6)  # narrower cubes would not fit a key
        events = events.withColumn("__v", sphere.vector(e("lat"), e("lon")))  # a column, so that it is computed once
        cells = (sphere.reached(F.col("__v"), chord), sphere.cube(sphere.vector(l("lat"), l("lon")), 2 * chord)) if chord < 1 else None
        # Latitudes alone tell most of the pairs of neighbouring cells apart, at less cost than a distance.
        close = (F.abs(l("lat") - e("lat")) <= F.lit(math.degrees(angle) + 1e-9)) & (away <= F.lit(self.distance_km))
        near = _meetings(events, places, t2, t1, self.after, self.before, close, cells, "right")
        made = {names[c]: quoted(f"__e_{c}") for c in other.column_names}
        made |= {self.get_name("delta_distance"): away, self.get_name("delta_time"): F.col("__t1") - F.col("__t2")}
        joined = near.select(*[quoted(f"__l_{c}").alias(c) for c in df.column_names], *[x.alias(c) for c, x in made.items()])
        return df._with(joined, df.spec.merge(other.spec.renamed(names)).select(joined.columns))


def nearest_distance(lat: Column, lon: Column, points: list[tuple[float, float]], radius: float = geo.EARTH_RADIUS) -> Column:
    """Distance to the nearest of a bounded list of points: an expression, without a join.

    Points are unit vectors, computed once: the nearest has the shortest chord, and only that one becomes an arc.
    """
    vectors = [(math.cos(p) * math.cos(q), math.cos(p) * math.sin(q), math.sin(p)) for p, q in ((math.radians(a), math.radians(b)) for a, b in points)]
    places = F.array(*[F.struct(*[F.lit(c).alias(n) for n, c in zip("xyz", v, strict=True)]) for v in vectors])
    p, q = F.radians(lat), F.radians(lon)
    here = F.struct((F.cos(p) * F.cos(q)).alias("x"), (F.cos(p) * F.sin(q)).alias("y"), F.sin(p).alias("z"))

    def shortest(h: Column) -> Column:
        square = lambda v, n: (v[n] - h[n]) * (v[n] - h[n])
        return F.array_min(F.transform(places, lambda v: square(v, "x") + square(v, "y") + square(v, "z")))

    chord = F.element_at(F.transform(F.array(here), lambda h: shortest(h)), 1)  # so that the row's vector is computed once
    half = F.sqrt(chord) / 2
    return F.lit(2.0 * radius) * F.asin(F.when(half > 1, F.lit(1.0)).otherwise(half))


#: Edge from which on places are settled by pairs of cells, and the edge of these cells: at most some 5,000 on the sphere.
_COARSE, _CELL = 1 / 8, 1 / 16


def nearest_join(df: DataFrame, lat: str, lon: str, points: DataFrame, p_lat: str, p_lon: str, out: str, radius: float = geo.EARTH_RADIUS) -> DataFrame:
    """Distance to the nearest of many points, without comparing all pairs.

    Places and points are unit vectors in cubes of one edge, so neither poles nor the date line are special. A place looks
    at the points of its own cube and of those around it: what lies elsewhere is farther than an edge away, so a shortest
    chord within the edge is final. Places that are not settled go on with cubes twice as large. Those with nothing within
    an eighth of the radius are settled by pairs of cells: a cell of points is of interest to a cell of places only if its
    least possible distance does not exceed the least of all greatest possible ones. The number of cells does not depend on
    the data, and every step is an equi-join. Distinct coordinates are joined once; a place without coordinates gets null.
    """
    from tessera.operators.tables import written

    places = df.select(quoted(lat).cast("double").alias("__lat"), quoted(lon).cast("double").alias("__lon")).where("__lat is not null and __lon is not null").distinct()
    spots = points.select(quoted(p_lat).cast("double").alias("p_lat"), quoted(p_lon).cast("double").alias("p_lon")).where("p_lat is not null and p_lon is not null").distinct()
    spots = written(spots.withColumn("q", sphere.vector(F.col("p_lat"), F.col("p_lon"))), "points")
    here, there = F.col("p"), F.col("q")
    best = F.min(F.struct(sphere.square(here, there).alias("d"), "p_lat", "p_lon")).alias("best")
    todo, done = places.withColumn("p", sphere.vector(F.col("__lat"), F.col("__lon"))), []
    edge, left = max(1e-6, math.sqrt(4 * math.pi / max(1, spots.count()))), True
    while edge <= _COARSE and left:
        near = spots.withColumn("cell", F.explode(sphere.around(there, edge)))
        found = todo.withColumn("cell", sphere.cube(here, edge)).join(near, "cell", "left").groupBy("__lat", "__lon").agg(F.first("p").alias("p"), best)
        sure = F.coalesce(F.col("best.d") <= edge * edge, F.lit(False))
        level = written(found.withColumn("sure", sure), "nearest")
        done.append(level.where("sure").select("__lat", "__lon", "best"))
        todo = level.where("not sure").select("__lat", "__lon", "p")
        left, edge = not todo.isEmpty(), edge * 2
    if left:
        cell = lambda v: sphere.cube(v, _CELL)
        mine, theirs = todo.withColumn("cell", cell(here)), spots.withColumn("cell_q", cell(there))
        ours, all_ = mine.select("cell").distinct(), theirs.select("cell_q").distinct()
        between = F.sqrt(sphere.square(sphere.centre("cell", _CELL), sphere.centre("cell_q", _CELL)))
        pairs = ours.join(F.broadcast(all_)).withColumn("m", between)  # of cells: 40,000 cubes of this edge meet the sphere at most
        # A place and a point are at most half a diagonal each from their centres.
        pairs = pairs.join(pairs.groupBy("cell").agg(F.min("m").alias("least")), "cell").where(F.col("m") <= F.col("least") + 2 * math.sqrt(3) * _CELL + 1e-9)
        far = mine.join(pairs.select("cell", "cell_q"), "cell").join(theirs, "cell_q")
        done.append(far.groupBy("__lat", "__lon").agg(best))
    settled = reduce(DataFrame.unionByName, done)
    away = geo.great_circle_distance(F.col("__lat"), F.col("__lon"), F.col("best.p_lat"), F.col("best.p_lon"), radius)
    same = quoted(lat).cast("double").eqNullSafe(F.col("__lat")) & quoted(lon).cast("double").eqNullSafe(F.col("__lon"))
    settled = settled.select("__lat", "__lon", away.alias("__best"))
    return df.join(settled, same, "left").drop("__lat", "__lon").withColumnRenamed("__best", out)


class NearestPoint(Step):
    """Distance in kilometres to the nearest point of a dataset, by haversine."""

    def __init__(self, dataset: DataFrame | AnnotatedFrame | str, columns: list[str], sep: str = ";", earth_radius_in_km: float = geo.EARTH_RADIUS):
        self.dataset, self.columns, self.sep, self.earth_radius_in_km = dataset, list(columns), sep, earth_radius_in_km

    @describe("Distance to the nearest point")
    @input({"x": {"unit": "deg", "representation_type": float}, "y": {"unit": "deg", "representation_type": float}})
    @output({"distance": {"unit": "km", "representation_type": float}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        data = self.dataset
        if isinstance(data, str):
            from tessera.sources.readers import read

            data = read(df.df.sparkSession, data, self.sep)
        table = data.df if isinstance(data, AnnotatedFrame) else data
        for c in self.columns:
            if c not in table.columns:
                raise KeyError(f"{type(self).__name__}: the dataset has no column '{c}'")
        lat, lon, out = self.get_name("x"), self.get_name("y"), self.get_name("distance")
        few = [tuple(r) for r in table.select(*self.columns).dropna().distinct().limit(MOST_LITERAL_POINTS + 1).collect()]
        if not few:
            raise ValueError(f"{type(self).__name__}: the dataset has no points")
        if len(few) <= MOST_LITERAL_POINTS:
            made = df.df.withColumn(out, nearest_distance(quoted(lat), quoted(lon), few, self.earth_radius_in_km))
        else:
            made = nearest_join(df.df, lat, lon, table, *self.columns, out, self.earth_radius_in_km)
        return df._with(made, df.spec)
