import datetime as dt
import math
import statistics

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from tessera.model import types
from tessera.model.annotations import Annotation, Change, History
from tessera.model.ranges import CyclicMinMax, ListOfValues, MinMax, from_dict
from tessera.model.spec import Category, ColumnSpec, FrameSpec, Merge
from tessera.model.stats import ColumnStats
from tessera.model.units import Unit


@pytest.mark.parametrize(("a", "b"), [("km / h", "km/h"), ("knots", "nmi / h"), ("rad / s", "rad s^-1"), ("deg", "degree"), ("m2", "m^2"), ("min", "minute")])
def test_equal_units(a, b):
    assert Unit.parse(a) == Unit.parse(b)
    assert Unit.parse(Unit.parse(a).to_string()) == Unit.parse(a)


def test_different_and_unknown_units():
    assert Unit.parse("km") != Unit.parse("m")
    assert Unit.parse("km") == Unit.parse("km") and Unit.parse("deg/min").to_string() == "deg / min"
    assert Unit.parse(None) is None
    with pytest.raises(ValueError, match="not known"):
        Unit.parse("furlong")


@pytest.mark.parametrize(("name", "kind"), [
    ("int", T.LongType()), (int, T.LongType()), ("Int8", T.ByteType()), ("UInt16", T.IntegerType()), ("UInt64", T.DecimalType(20, 0)), ("Float32", T.FloatType()),
    (float, T.DoubleType()), ("String", T.StringType()), ("Boolean", T.BooleanType()), ("Datetime(time_unit='us', time_zone='UTC')", T.TimestampType()),
    ("Datetime(time_unit='ms')", T.TimestampNTZType()), ("datetime", T.TimestampNTZType()), ("List(Int32)", T.ArrayType(T.IntegerType())), ("decimal(10,2)", T.DecimalType(10, 2)),
    ("array<bigint>", T.ArrayType(T.LongType())), ("Duration(time_unit='us')", T.DayTimeIntervalType()),
])
def test_type_names(name, kind):
    assert types.resolve(name) == kind
    assert types.resolve(types.show(kind)) == kind


def test_unknown_type():
    with pytest.raises(ValueError, match="not known"):
        types.resolve("__import__('os')")


def test_minmax():
    r = MinMax(0.0, 1.0)
    assert r.is_in_range(0) and r.is_in_range(1 + 5e-8) and not r.is_in_range(1.1)
    assert r.is_in_range(None) and r.is_in_range(math.nan) and not MinMax(0, 1, allow_missing=False).is_in_range(None)
    assert not MinMax(0, 1).is_in_range(2)
    with pytest.raises(ValueError, match="both"):
        MinMax(None, 1)
    with pytest.raises(RuntimeError, match="greater"):
        MinMax(2, 1)
    assert MinMax(0, 3).merge(MinMax(-1, 2, allow_missing=False)) == MinMax(-1, 3, allow_missing=False)
    assert MinMax(0, 3) != CyclicMinMax(0, 3)


def test_lists():
    assert 1 in ListOfValues([1, 2]) and 3 not in ListOfValues([1, 2])
    assert ListOfValues(["b", None]).merge(ListOfValues(["a"])).values == ["a", "b", None]
    assert ListOfValues([7, 9]).merge(MinMax(0, 8)) == MinMax(0, 9)
    with pytest.raises(ValueError, match="list"):
        ListOfValues("ab")


@pytest.mark.parametrize("r", [MinMax(0, 3), CyclicMinMax(-180.0, 180.0, allow_missing=False), ListOfValues(["a", None])])
def test_ranges_persist(r):
    data = r.to_dict()
    assert from_dict(data) == r and data == r.to_dict()


def test_range_of_times_persists():
    c = ColumnSpec("t", representation_type="datetime", value_range=MinMax(dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)))
    assert ColumnSpec.from_dict(c.to_dict()) == c


@given(st.lists(st.floats(-1e3, 1e3), min_size=2, max_size=20), st.lists(st.floats(-1e3, 1e3), min_size=2, max_size=20))
def test_pooled_statistics_are_those_of_the_union(a, b):
    of = lambda x: ColumnStats(statistics.mean(x), statistics.stdev(x), len(x), 1)
    merged, whole = of(a).merge(of(b)), of(a + b)
    assert merged.mean == pytest.approx(whole.mean, abs=1e-6) and merged.stddev == pytest.approx(whole.stddev, abs=1e-6)
    assert (merged.total_count, merged.null_count) == (len(a) + len(b), 2)


def test_annotations():
    with pytest.raises(ValueError, match="empty"):
        Annotation("license", "")
    with pytest.raises(ValueError, match="zone"):
        Change("x", "", dt.datetime(2020, 1, 1))
    one = Change("b", "", dt.datetime(2020, 1, 1, 0, 0, 0, 5, tzinfo=dt.timezone.utc))
    assert one.timestamp.microsecond == 0
    h = History([one, Change("a")])
    assert [c.title for c in h.changes] == sorted(c.title for c in h.changes)
    assert Annotation.from_dict(h.to_dict()) == h
    assert len(h.merge(History([one])).changes) == 2
    stored = {"title": "x", "timestamp": "2020-01-01T00:00:00"}
    assert Change.from_dict(stored).timestamp.tzinfo is dt.timezone.utc


def test_column_spec_rules():
    with pytest.raises(ValueError, match="need a range"):
        ColumnSpec("x", value_meanings={1: "one"})
    with pytest.raises(ValueError, match="outside"):
        ColumnSpec("x", value_range=MinMax(2, 3), value_meanings={1: "one"})
    with pytest.raises(KeyError, match="is_optional"):
        ColumnSpec.from_dict({"name": "x"})
    with pytest.raises(ValueError, match="twice"):
        FrameSpec([ColumnSpec("x"), ColumnSpec("x")])


FULL = ColumnSpec("x", "text", Category.STATIC, True, "X", float, -1.0, 0.5, "km / h", MinMax(0.0, 9.0), ColumnStats(1, 2, 3, 4), {1.0: "one"})


def test_spec_persistence(tmp_path):
    spec = FrameSpec([FULL, ColumnSpec("b")], [Annotation("comment", "c"), History([Change("made")])])
    assert [c.name for c in spec.columns] == ["b", "x"]
    spec.save_yaml(tmp_path / "s.yaml")
    assert FrameSpec.load_yaml(tmp_path / "s.yaml") == spec
    text = (tmp_path / "s.yaml").read_text()
    assert text.index("name") < text.index("is_optional")


def test_missing_value_needs_a_type():
    assert ColumnSpec.from_dict({"name": "x", "is_optional": False, "missing_value": 1, "precision": 2}).missing_value is None


def test_fulfilment():
    assert ColumnSpec("x").unfulfilled(FULL) == []
    assert ColumnSpec("x", unit="km/h", precision=0.6, representation_type=float).unfulfilled(FULL) == []
    assert ColumnSpec("x", unit="m", precision=0.4).unfulfilled(FULL) == ["precision", "unit"]
    assert ColumnSpec("x", precision=0.4).unfulfilled(ColumnSpec("x")) == ["precision"]
    wide = ColumnSpec("x", value_range=MinMax(-1.0, 10.0))
    assert wide.unfulfilled(FULL) == ["value_range"] and wide.unfulfilled(FULL, containment=True) == []
    need = FrameSpec([ColumnSpec("x"), ColumnSpec("y"), ColumnSpec("z", is_optional=True)])
    assert need.unfulfilled(FrameSpec([FULL])) == {"y": ["missing"]}


def test_merge():
    a, b = ColumnSpec("x", unit="km", value_range=MinMax(0, 2), value_stats=ColumnStats(1, 1, 2)), ColumnSpec("x", description="d", value_range=MinMax(1, 5), value_stats=ColumnStats(2, 1, 2))
    m = a.merge(b)
    assert (m.description, m.value_range, m.value_stats.total_count) == ("d", MinMax(0, 5), 4)
    with pytest.raises(ValueError, match="two values"):
        a.merge(ColumnSpec("x", unit="m"))
    assert a.merge(ColumnSpec("x", unit="m"), Merge.THIS).unit == "km"
    assert a.merge(ColumnSpec("x", unit="m"), Merge.OTHER).unit == "m"
    left = FrameSpec([a], [Annotation("comment", "l"), History([Change("one")])])
    right = FrameSpec([b, ColumnSpec("y")], [Annotation("source", "s"), History([Change("two")])])
    both = left.merge(right)
    assert both.column_names == ["x", "y"] and set(both.annotations) == {"comment", "source", "history"}
    assert len(both.annotations["history"].changes) == 2
