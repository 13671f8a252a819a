import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.domains.maritime import data, generator
from tessera.domains.maritime.steps import AddVesselType, cleanse_and_sanitise, data_processing
from tessera.frame import AnnotatedFrame
from tessera.functions import geo, scalar
from tessera.model.spec import ColumnSpec, FrameSpec, Mode
from tessera.operators import augment, filters, joins, sequences, statistics, timeseries, visual
from tessera.operators.tables import written
from tessera.plans import registry


def wrap(df, *specs):
    return AnnotatedFrame(df, FrameSpec([ColumnSpec(f.name, representation_type=f.dataType) for f in df.schema]).with_columns(*specs), Mode.IGNORE)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_cyclic_round_trip_and_nulls(spark):
    df = spark.createDataFrame([(float(k),) for k in range(0, 360, 5)] + [(None,)], "x double")
    s, c = scalar.cyclic_normalisation(F.col("x"), 0, 360)
    for r in df.select("x", scalar.cyclic_denormalisation(s, c, 0, 360).alias("y"), s.alias("s")).collect():
        assert r["y"] is None if r["x"] is None else r["y"] == pytest.approx(r["x"], abs=1e-6)
    assert one(spark, scalar.cyclic_denormalisation(F.lit(1.0000001), F.lit(0.0), 0, 1)) is not None
    with pytest.raises(ValueError, match="empty"):
        scalar.normalize(F.lit(1), 2, 2)


def test_cyclic_round_trip_beyond_the_range(spark, tmp_path):
    places = [-720.0, -361.5, -360.0, -1e-9, 0.0, 1e-9, 90.0, 179.999999, 180.0, 180.000001, 270.0, 359.9999999, 360.0, 360.5, 719.0, 720.0, 1e6 + 0.25]
    df = spark.createDataFrame([(x,) for x in places] + [(None,)], "x double")
    s, c = scalar.cyclic_normalisation(F.col("x"), 0, 360)
    back = scalar.cyclic_denormalisation(s, c, 0, 360, scalar.half_turns(F.col("x"), 0, 360))
    for r in df.select("x", back.alias("y")).collect():
        assert r["y"] is None if r["x"] is None else r["y"] == pytest.approx(r["x"], abs=2e-6)
    values = [0.0, 250.0, 499.99, 500.0, 520.16, 560.21, -3.5, 1500.0]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert [r["v"] for r in registry.cyclic_roundtrip(spark, str(tmp_path)).orderBy("event_id").collect()] == values


def test_geometry(spark):
    oslo, rome = (F.lit(59.9139), F.lit(10.7522)), (F.lit(41.9028), F.lit(12.4964))
    assert one(spark, geo.great_circle_distance(*oslo, *rome)) == pytest.approx(2007, abs=3)
    assert one(spark, geo.great_circle_distance(F.lit(None).cast("double"), *oslo[1:], *rome)) is None
    lat, lon = geo.destination(*oslo, geo.great_circle_distance(*oslo, *rome), geo.bearing(*oslo, *rome))
    assert (one(spark, lat), one(spark, lon)) == (pytest.approx(41.9028), pytest.approx(12.4964))
    assert one(spark, F.struct(*geo.to_dms(F.lit(-10.2583)))) == (-10.0, 15.0, pytest.approx(29.88))
    for d, m, s, x in ((-0.0, 30.0, 0.0, -0.5), (0.0, 30.0, 0.0, 0.5), (-10.0, 15.0, 29.88, -10.2583)):
        assert one(spark, geo.from_dms(F.lit(d), F.lit(m), F.lit(s))) == pytest.approx(x)
    chord = geo.chord_distance(F.lit(1000.0))
    assert one(spark, chord) == pytest.approx(2 * 6371 * math.sin(1000 / 2 / 6371))
    flat = geo.satellite_vessel_distance(F.lit(3.0), F.lit(4.0), F.lit(math.pi / 2))
    assert one(spark, flat) == pytest.approx(5.0)
    assert one(spark, geo.satellite_angle(F.lit(0.0))) == pytest.approx(math.pi / 2)


def test_times_and_identities(spark):
    assert one(spark, scalar.epoch_seconds(F.lit("2020-01-01 00:00:01.2345"))) == 1577836801.234
    assert one(spark, scalar.epoch_seconds(F.lit(None).cast("string"))) is None
    assert math.isnan(one(spark, scalar.try_epoch_seconds(F.lit("never"))))
    assert one(spark, scalar.mmsi_country(F.lit(257123456))) == 257 and one(spark, scalar.mmsi_national(F.lit(257123456))) == 123456
    with pytest.raises(Exception, match="unknown kind"):
        one(spark, scalar.strict_lookup(F.lit("x"), {"a": 1}, "kind"))


def test_filter_language(spark):
    df = spark.createDataFrame([(1, "Alpha", 1.5), (2, None, 2.5), (3, "gamma", None)], "i long, s string, f double")
    ids = lambda *e: sorted(r["i"] for r in filters.filter_by_expressions(df, e).collect())
    assert ids("i >= 2") == [2, 3] and ids("s =~ a.*a") == [3] and ids("s == null") == [2] and ids("s != None") == [1, 3]
    assert ids("i <> 2", "f < 2") == [1] and ids("s == 'gamma'") == [3] and ids("i != 1") == [2, 3]
    for bad in ("i ~ 3", "zzz == 1", "i < null", "__import__('os').system('x')"):
        with pytest.warns(UserWarning, match="Filter"):
            assert ids(bad) == [1, 2, 3]


def test_long_value_lists_become_a_join(spark):
    df = spark.range(5000)
    out = filters.within(df, "id", list(range(0, 4000, 2)))
    assert out.count() == 2000


def test_fill_change_type(spark):
    f = wrap(spark.createDataFrame([(1.9,), (float("nan"),), (None,)], "x double"))
    filled = augment.AddUndefinedValue(-1.0).transform(f)
    assert sorted(r[0] for r in filled.collect()) == [-1.0, -1.0, 1.9]
    typed = augment.ChangeTypeColumn("Int32").map_names({"y": "z"}).transform(filled)
    assert sorted(r["z"] for r in typed.collect()) == [-1, -1, 1]
    with pytest.raises(TypeError):
        augment.ChangeTypeColumn("NoSuch")
    assert augment.Normalize().transform(wrap(spark.createDataFrame([(0.0,), (4.0,)], "x double"))).columns == ["x", "x_normalized"]


def test_join_checks(spark):
    types = spark.createDataFrame([(1, "cargo"), (2, "no such")], "k long, kind string")
    f = wrap(spark.createDataFrame([(1,), (7,)], "mmsi long"))
    with pytest.raises(KeyError):
        AddVesselType(types, "zzz", "kind")
    with pytest.raises(ValueError, match="integer column"):
        joins.JoinDataFrameByColumn(types, "k", "kind")
    with pytest.raises(ValueError, match="names or ids"):
        AddVesselType(types.withColumn("kind", F.lit(1.5)), "k", "kind")
    with pytest.raises(Exception, match="unknown kind"):
        AddVesselType(types, "k", "kind").map_names({"x": "mmsi"}).transform(f).collect()
    out = AddVesselType(types.where("k = 1"), "k", "kind").map_names({"x": "mmsi"}).transform(f)
    assert sorted((r["mmsi"], r["out"]) for r in out.collect()) == [(1, 1), (7, None)]


def test_interval_join_against_loops(spark):
    rng = np.random.default_rng(1)
    a, b = [(k, float(t)) for k, t in enumerate(rng.integers(-500, 500, 80))], [(k, float(t)) for k, t in enumerate(rng.integers(-500, 500, 90))]
    for before, after in ((10, 30), (0, 0), (25, 0)):
        left, right = spark.createDataFrame(a, "i long, t double"), spark.createDataFrame(b, "j long, u double")
        out = joins.interval_join(left, right, F.col("t"), F.col("u"), before, after)
        assert sorted((r["i"], r["j"]) for r in out.collect()) == sorted((i, j) for i, t in a for j, u in b if t - before <= u <= t + after)
        assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()


def test_positions_and_events(spark):
    """The nine positions of one vessel, ten seconds apart, and events near and far."""
    track = [(5, float(10 * k), 60.0, 5.0 + k / 1000) for k in range(9)]
    events = [(40.0, 60.0, 5.0, "near"), (40.0, -60.0, 5.0, "far"), (1e7, 60.0, 5.0, "late")]
    deg = [ColumnSpec(c, unit="deg", representation_type=float) for c in ("lat", "lon")]
    p = wrap(spark.createDataFrame(track, "mmsi long, t double, lat double, lon double"), *deg)
    e = wrap(spark.createDataFrame(events, "t double, lat double, lon double, kind string"), *deg)
    step = joins.JoinByIntervalAndDistance(20, 30, 50.0).map_names({"id": "mmsi", "time": "t"}).map_names({"time": "t"}, "other")
    out = step.transform(p, other=e)
    rows = sorted(out.collect(), key=lambda r: r["t"])
    assert len(rows) == 9 and [r["kind"] for r in rows] == [None, "near", "near", "near", "near", "near", "near", None, None]
    assert rows[2]["delta_time"] == 20.0 and out.spec["delta_distance"].unit == "km"
    assert out.columns == ["mmsi", "t", "lat", "lon", "t_other", "lat_other", "lon_other", "kind", "delta_distance", "delta_time"]


def haversine(a, b, c, d, r=6371.0):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * r * math.asin(math.sqrt(min(1, h)))


def test_positions_and_events_against_loops_in_one_join(spark):
    """Poles, the date line, copies and missing values; pairs are not joined back to the positions."""
    rng = np.random.default_rng(3)
    lats, lons = [-90.0, -89.9, 0.0, 89.8, 90.0], [-180.0, -179.9, 0.0, 90.0, 179.9, 180.0]
    some = lambda n: [(float(rng.integers(0, 400)), float(rng.choice(lats) if k % 2 else rng.uniform(-90, 90)), float(rng.choice(lons))) for k in range(n)]
    track = [(k, *x) for k, x in enumerate(some(120))]
    track += track[:5] + [(900, None, 1.0, 1.0), (901, 5.0, None, 1.0), (None, 5.0, 90.0, 1.0)]
    events = [(*x, k) for k, x in enumerate(some(100))] + [(None, 90.0, 0.0, 200), (5.0, 90.0, None, 201), (5.0, 90.0, 1.0, 202)]
    deg = [ColumnSpec(c, unit="deg", representation_type=float) for c in ("lat", "lon")]
    p = wrap(spark.createDataFrame(track, "mmsi long, t double, lat double, lon double"), *deg)
    e = wrap(spark.createDataFrame(events, "t double, lat double, lon double, kind long"), *deg)
    for km in (0.0, 30.0, 900.0, 30000.0):
        step = joins.JoinByIntervalAndDistance(20, 70, km).map_names({"id": "mmsi", "time": "t"}).map_names({"time": "t"}, "other")
        out = step.transform(p, other=e)
        expected = []
        for i, t, a, b in track:
            met = [k for u, c, d, k in events if None not in (t, a, b, u, c, d) and t - 20 <= u <= t + 70 and haversine(a, b, c, d) <= km]
            expected += [(str(i), str(k)) for k in met or [None]]
        assert sorted((str(r["mmsi"]), str(r["kind"])) for r in out.collect()) == sorted(expected)
        plan = out.df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Join") == 1, plan


def test_interval_join_keeps_right_rows(spark):
    left, right = spark.createDataFrame([(1, 0.0), (2, 5.0)], "i long, t double"), spark.createDataFrame([(7, 4.0), (8, 99.0), (9, None)], "j long, u double")
    out = joins.interval_join(left, right, F.col("t"), F.col("u"), 3, 10, how="right")
    assert out.columns == ["i", "t", "j", "u"] and sorted((str(r["i"]), r["j"]) for r in out.collect()) == [("1", 7), ("2", 7), ("None", 8), ("None", 9)]
    with pytest.raises(ValueError, match="several keys"):
        joins.interval_join(left, right, F.col("t"), F.col("u"), 3, 10, how="left")


def test_nearest_points_by_grid_against_loops(spark):
    rng = np.random.default_rng(2)
    points = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60), strict=True)]
    places = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 80), rng.uniform(-180, 180, 80), strict=True)] + [(90.0, 0.0), (-90.0, 179.0), (0.0, 180.0), (None, 1.0)]
    df = spark.createDataFrame(places, "lat double, lon double")
    table = spark.createDataFrame(points, "a double, b double")
    out = joins.nearest_join(df, "lat", "lon", table, "a", "b", "km").collect()
    assert len(out) == len(places)
    for r in out:
        best = None if r["lat"] is None else min(haversine(r["lat"], r["lon"], a, b) for a, b in points)
        assert r["km"] == (None if best is None else pytest.approx(best))


def test_track_windows(spark):
    rows = [(1, 3, 0.0, 2.0), (1, 1, 0.0, 0.0), (1, 2, 0.0, 1.0), (2, 1, 5.0, 5.0)]
    deg = [ColumnSpec(c, unit="deg", representation_type=float) for c in ("lat", "lon")]
    f = wrap(spark.createDataFrame(rows, "g long, t long, lat double, lon double"), *deg)
    names = {"group": "g", "sort": "t", "time_column": "t", "x": "lat", "y": "lon"}
    idx = timeseries.AddLocalIndex().map_names(names).transform(f)
    assert sorted((r["g"], r["t"], r["local_index"], r["reverse_local_index"]) for r in idx.collect()) == [(1, 1, 0, 2), (1, 2, 1, 1), (1, 3, 2, 0), (2, 1, 0, 0)]
    dt = timeseries.AddDeltaTime().map_names(names).transform(f)
    assert sorted((r["g"], r["t"], r["delta_time"]) for r in dt.collect()) == [(1, 1, 0.0), (1, 2, 1.0), (1, 3, 1.0), (2, 1, 0.0)]
    km = timeseries.DeltaDistance().map_names(names).transform(f)
    step = 6373 * math.radians(1)
    assert [r["out"] for r in km.collect()] == [pytest.approx(step)] * 2
    only = timeseries.DeltaDistance(x_shift=False).map_names(names).transform(f)
    assert only.count() == 2
    assert timeseries.DeltaDistance(x_shift=False, y_shift=False).map_names(names).transform(f).count() == 4
    both = timeseries.Heading(across_groups=True).map_names(names).transform(f)
    assert both.count() <= 1


def test_elapsed_microseconds_are_exact(spark):
    """As differences of seconds since 1970, 7 microseconds would be 6.91 and 58867 of them 58866.98."""
    for gap in (7, 58867):
        rows = [(1, k, micros, float(k), float(k * k)) for k, micros in enumerate((0, 13, 13 + gap, 400000))]
        df = spark.createDataFrame(rows, "g long, k long, micros long, lat double, lon double")
        df = df.withColumn("t", F.timestamp_micros(F.lit(1704585600000000) + F.col("micros"))).withColumn("h", F.col("k") * 0.5)
        deg = [ColumnSpec(c, unit="deg", representation_type=float) for c in ("lat", "lon")]
        turned = timeseries.Heading().map_names({"group": "g", "sort": "t"}).transform(wrap(df, *deg)).collect()
        assert [r["angular_velocity"] for r in turned] == [turned[0]["delta_heading"] / (gap / 1e6)]


def test_speed_drops_rows_without_time(spark):
    specs = ColumnSpec("delta_distance", unit="km"), ColumnSpec("delta_time", unit="s")
    f = wrap(spark.createDataFrame([(1.0, 3600.0), (1.0, 0.0), (1.0, None)], "delta_distance double, delta_time double"), *specs)
    assert [r["speed"] for r in timeseries.Speed().transform(f).collect()] == [1.0]


def test_sequences(spark):
    rows = [(g, t, float(t), float(t * t)) for g in range(3) for t in range(10 + g)]
    df = spark.createDataFrame(rows, "id long, t long, x double, y double").repartition(3)
    out = sequences.sequences(df, ["t"], ["x", "y"], 4, 2, ["x"], "id")
    assert out.count() == sum(10 + g - 5 for g in range(3))
    for r in out.where("id = 1").collect():
        assert [tuple(s) for s in r["X"]] == [(float(r["start"] + k), float((r["start"] + k) ** 2)) for k in range(4)]
        assert [s["x"] for s in r["y"]] == [float(r["start"] + 4 + k) for k in range(2)]
    x, y = next(sequences.to_arrays(out))
    assert x.shape == (4, 2) and y.shape == (2, 1)
    with pytest.raises(ValueError, match="different types"):
        sequences.sequences(df, ["t"], ["t", "x"], 3)
    one_ = sequences.random_sequences(df, "id", ["t"], ["x"], 11, 0, batch=50, seed=1)
    assert {r["id"] for r in one_.collect()} <= {1, 2}
    with pytest.raises(RuntimeError, match="no group"):
        sequences.random_sequences(df, "id", ["t"], ["x"], 50)
    a = sequences.random_sequences(df, "id", ["t"], ["x"], 4, batch=5, seed=1).collect()
    assert a == sequences.random_sequences(df.repartition(2), "id", ["t"], ["x"], 4, batch=5, seed=1).collect()


def test_split(spark):
    df = spark.range(5000).select((F.col("id") % 101).alias("g"))
    parts = sequences.split_groups(df, "g", [0.8, 0.1, 0.1], seed=5)
    sets = [{r[0] for r in p.distinct().collect()} for p in parts]
    assert list(map(len, sets)) == sequences.largest_remainder(101, [0.8, 0.1, 0.1]) and len(set().union(*sets)) == 101
    assert [{r[0] for r in p.distinct().collect()} for p in sequences.split_groups(df.repartition(3), "g", [0.8, 0.1, 0.1], seed=5)] == sets
    assert sequences.largest_remainder(3, [0.5, 0.5]) == [2, 1] and sequences.largest_remainder(0, [1, 1]) == [0, 0]
    assert list(sequences.train_test_validate(df, "g")) == ["train", "test", "validate"]
    assert [p.count() for p in sequences.split_groups(df.where("g = 1"), "g", [1.0, 0.0])] == [50, 0]
    assert sequences.shuffled(df, 1).count() == 5000
    with pytest.raises(ValueError, match="positive"):
        sequences.split_groups(df, "g", [0, 0])


def test_statistics(spark):
    x = [float(k) for k in range(200)]
    df = spark.createDataFrame([(k % 7, v) for k, v in enumerate(x)], "g long, x double")
    s = np.std(x, ddof=1)
    assert statistics.n_sigma(df, "x", 2).first()[0] == pytest.approx(np.median(x) + 2 * s)
    low = [v for v in x if v < np.quantile(x, 0.9)]
    assert statistics.n_sigma_limited(df, "x", 1, 0.9).first()[0] == pytest.approx(np.median(low) + np.std(low, ddof=1))
    pooled = statistics.pooled_stats(df, "x", "g").first()
    assert (pooled["mean"], pooled["stddev"]) == (pytest.approx(np.mean(x)), pytest.approx(s))
    assert sum(r["n"] for r in statistics.histogram(df, "x", 7, 0, 199).collect()) == 200
    assert written(df).count() == 200


def test_pictures_pass_data_through(spark, tmp_path):
    deg = [ColumnSpec(c, unit="deg", representation_type=float) for c in ("lat", "lon")]
    f = wrap(spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "lat double, lon double"), *deg)
    assert visual.PlotLatLon(tmp_path).map_names({"x": "lat", "y": "lon"}).transform(f).df is f.df
    visual.PlotHistograms(tmp_path).transform(f)
    assert len(list(tmp_path.iterdir())) == 3


def test_generator_and_domain_pipelines(spark):
    messages = generator.positions(spark, 12, 10, 40, seed=4)
    again = generator.positions(spark, 12, 10, 40, seed=4)
    assert messages.exceptAll(again).isEmpty() and messages.columns[:4] == ["mmsi", "lon", "lat", "date_time_utc"]
    specs = [ColumnSpec(c, unit="deg", representation_type=float) for c in ("lat", "lon")]
    clean = cleanse_and_sanitise(types={"nav_status": "Int8"}, drop_missing=["mmsi"]).transform(wrap(messages, *specs))
    assert {r[0] for r in clean.select("source").distinct().collect()} == {"s"}
    assert clean.where("date_time_utc is null or nav_status is null").count() == 0
    assert dict(clean.df.dtypes)["nav_status_Int8"] == "tinyint" and clean.spec["timestamp"].unit == "s"
    types, fishing = generator.vessel_types(messages), generator.fishing_types(messages)
    out = data_processing(types, fishing, generator.anchorages(spark, 30)).transform(clean)
    rows = out.collect()
    assert len(rows) == clean.count() and all(r["distance_closest_anchorage"] >= 0 for r in rows)
    assert {r["vessel_type"] for r in rows} <= set(range(23)) and {r["fishing_type"] for r in rows} <= set(range(8, 23))
    by = {}
    for r in rows:
        by.setdefault(r["mmsi"], []).append((r["event_index"], r["reverse_event_index"]))
    assert all(sorted(v) == [(k, len(v) - 1 - k) for k in range(len(v))] for v in by.values())


def test_maritime_constants():
    assert data.vessel_type_id("fishing") == 7 and data.vessel_type_name(22) == "other_seines" and len(data.VESSEL_TYPES) == 23
    with pytest.raises(KeyError):
        data.vessel_type_id("submarine")
    assert len(data.NAVIGATION_STATUS) == 16 and all(s.value_range is not None for s in data.POSITION_SPECS)


def test_nearest_points_of_places_anywhere(spark):
    """Dense and lonely points, poles, the date line, antipodes and repeated places, against all pairs."""
    draw = random.Random(3)
    points = [(draw.uniform(50, 52), draw.uniform(3, 5)) for _ in range(600)] + [(90.0, 0.0), (-0.5, 179.99), (0.1, -179.98)]
    places = [(draw.uniform(-90, 90), draw.uniform(-180, 180)) for _ in range(150)] + [(90.0, 77.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0), (51.0, 4.0), (51.0, 4.0), (None, 1.0)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "k long, lat double, lon double")
    table = spark.createDataFrame(points, "a double, b double")
    out = {r["k"]: r["d"] for r in joins.nearest_join(df, "lat", "lon", table, "a", "b", "d").collect()}

    def away(p, q):
        a, b, c, d = map(math.radians, (*p, *q))
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    assert len(out) == len(places) and out.pop(len(places) - 1) is None
    for k, d in out.items():
        assert d == pytest.approx(min(away(places[k], q) for q in points), abs=1e-6), places[k]


def test_text_groups_do_not_pass_the_contract(spark):
    f = wrap(spark.createDataFrame([("a", 1)], "g string, t long"))
    with pytest.raises((RuntimeError, ValueError)):
        timeseries.AddLocalIndex().map_names({"group": "g", "sort": "t"}).transform(f)
