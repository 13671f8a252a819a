import math
import zipfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import validation
from tessera.frame import AnnotatedFrame
from tessera.model.annotations import Annotation
from tessera.model.ranges import ListOfValues, MinMax
from tessera.model.spec import ColumnSpec, FrameSpec, Mode
from tessera.sources import archive, csv, readers, specfiles, writers


def longs(spark, **columns):
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{n} long" for n in names))


def spec(**ranges):
    return FrameSpec([ColumnSpec(n, representation_type=int, **r) for n, r in ranges.items()])


def values(df, name):
    return sorted((r[name] for r in df.collect()), key=lambda v: (v is None, v))


IDS = [0, -1, 2, 3, 8, 12, 52, 40, 18]


@pytest.mark.parametrize(("allowed", "expected"), [(True, [0, 2, 3, 8, 12, 18, 40, None]), (False, [0, 2, 3, 8, 12, 18, 40])])
def test_update_data_drops_rows_out_of_range(spark, allowed, expected):
    f = AnnotatedFrame(longs(spark, mmsi=[*IDS, None]), spec(mmsi={"value_range": MinMax(0, 40, allow_missing=allowed)}), Mode.UPDATE_DATA)
    assert values(f.df, "mmsi") == expected


def test_update_data_conditions_conjoin_and_replace(spark):
    df = longs(spark, x=[0, 1, 2, 3, 4, 5], y=[8, 9, 10, 11, 12, 13])
    f = AnnotatedFrame(df, spec(x={"value_range": MinMax(0, 3)}, y={"value_range": MinMax(9, 15)}), Mode.UPDATE_DATA)
    assert values(f.df, "x") == [1, 2, 3]
    f = AnnotatedFrame(df, spec(x={"value_range": MinMax(0, 3), "missing_value": 3}, y={"value_range": MinMax(8, 11), "missing_value": 15}), Mode.UPDATE_DATA)
    assert values(f.df, "x") == [0, 1, 2, 3, 3, 3] and values(f.df, "y") == [8, 9, 10, 11, 15, 15]


def test_update_data_casts_with_a_warning(spark):
    with pytest.warns(UserWarning, match="cast"):
        f = AnnotatedFrame(longs(spark, x=[1]), FrameSpec([ColumnSpec("x", representation_type=float)]), Mode.UPDATE_DATA)
    assert f.dtype("x") == T.DoubleType()


def test_readonly(spark):
    df = longs(spark, x=[0, 5, None])
    AnnotatedFrame(df, spec(x={"value_range": MinMax(0, 5)}))
    with pytest.raises(ValueError, match="lie outside of range"):
        AnnotatedFrame(df, spec(x={"value_range": MinMax(0, 4)}))
    with pytest.raises(ValueError, match="is bigint, not string"):
        AnnotatedFrame(df, FrameSpec([ColumnSpec("x", representation_type=str)]))
    with pytest.raises(ValueError, match="Missing column 'y'"):
        AnnotatedFrame(df, spec(x={}, y={}), Mode.IGNORE)
    with pytest.raises(ValueError, match="Missing specification of column 'x'"):
        AnnotatedFrame(df, FrameSpec())
    listed = spec(x={"value_range": ListOfValues([0])})
    AnnotatedFrame(df, listed)
    with pytest.raises(ValueError, match="lie outside"):
        validation.apply(df, listed, Mode.READONLY, membership=True)
    with pytest.raises(ValueError, match="DataFrame"):
        AnnotatedFrame([1, 2], FrameSpec())


def test_one_job_validates_all_columns(spark):
    df = longs(spark, **{f"c{k}": [1, 2] for k in range(5)})
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("validate", "")
    AnnotatedFrame(df, spec(**{f"c{k}": {"value_range": MinMax(0, 3)} for k in range(5)}))
    # with adaptive execution the shuffle of an aggregation is a job of its own
    assert len(tracker.getJobIdsForGroup("validate")) <= 2
    spark.sparkContext.setJobGroup("", "")


def test_inference(spark):
    rows = [(k, float(k) if k else math.nan, "ab"[k % 2], f"{k:02}:{k:02}", f"v{k}") for k in range(5)]
    df = spark.createDataFrame(rows, "i long, f double, s string, t string, v string")
    s = validation.infer(df)
    assert s["i"].value_range == MinMax(0, 4) and s["i"].value_stats.total_count == 5
    assert s["f"].value_range == MinMax(1.0, 4.0) and s["f"].value_stats.mean == 2.5
    assert s["s"].value_range == ListOfValues(["a", "b"]) and s["s"].value_stats is None
    assert isinstance(s["t"].value_range, MinMax)  # looks like times of day
    assert validation.categories(df, "v", most=4) is None
    one = validation.infer(longs(spark, x=[3]))
    assert one["x"].value_stats is None and one["x"].value_range == MinMax(3, 3)


def test_update_metadata_keeps_what_is_known(spark):
    f = AnnotatedFrame(longs(spark, x=[1, 2]), FrameSpec([ColumnSpec("x", unit="m")]), Mode.UPDATE_METADATA)
    assert f.spec["x"].unit == "m" and f.spec["x"].value_range == MinMax(1, 2)


def test_forwarding(spark):
    f = AnnotatedFrame(longs(spark, x=[1, 2, 2], y=[None, 5, 6]), spec(x={"unit": "m"}, y={}))
    assert f.shape == (3, 2) and f["x"].columns == ["x"] and f.x.count() == 3 and "y" in f
    assert f.minmax("y") == (5, 6) and f.categories("x") == [1, 2] and f.null_count().first()["y"] == 1
    assert f.drop_nulls("y").count() == 2 and f.unique("x").count() == 2 and f.head(1).count() == 1
    assert f.drop("y").spec.column_names == ["x"]
    with pytest.raises(KeyError):
        f.drop("z")
    assert f.rename({"x": "z"}).spec["z"].unit == "m"
    f["z"] = F.col("x") * 2
    assert f.select("z").first()[0] == 2
    with pytest.raises(ValueError, match="Column"):
        f["z"] = [1]
    assert f.equals(f.df.orderBy("x")) and not f.equals(f.df.limit(2))


def test_from_values_on_the_driver(spark):
    f = AnnotatedFrame.from_dict(spark, {"x": [1, 2], "s": ["a", "b"]})
    assert f.spec["x"].value_range == MinMax(1, 2) and f.spec["s"].value_range == ListOfValues(["a", "b"])


def test_metadata_travels_in_fields(spark, tmp_path):
    f = AnnotatedFrame(longs(spark, x=[1]), spec(x={"unit": "km", "value_range": MinMax(0, 5)}))
    f.export(tmp_path / "e.parquet")
    back = AnnotatedFrame.from_files(spark, [tmp_path / "e.parquet"])
    assert back.spec["x"] == f.spec["x"]
    assert ColumnSpec.from_field(f.annotated.where("x = 1").schema["x"]).unit == "km"


def test_output_update(spark):
    f = AnnotatedFrame(longs(spark, x=[1]), FrameSpec([ColumnSpec("x", unit="m", value_range=MinMax(0, 1))]))
    made = f.updated(f.df.withColumn("y", F.lit(1)), FrameSpec([ColumnSpec("x", value_range=MinMax(0, 9)), ColumnSpec("y", unit="s")]))
    assert made.spec["x"].value_range == MinMax(0, 9) and made.spec["x"].unit == "m" and made.spec["y"].unit == "s"
    assert f.updated(f.df, FrameSpec([ColumnSpec("x")])).spec["x"].value_range is None
    with pytest.raises(ValueError, match="not in the data"):
        f.updated(f.df, FrameSpec([ColumnSpec("q")]))


# -- files -------------------------------------------------------------------------------------------------------------


def write(path, text):
    path.write_text(text)
    return path


def test_csv_nulls_quotes_and_separators(spark, tmp_path):
    a = write(tmp_path / "a.csv", "height,letter\n0,a\n1,b\n2,None\nNone,c\nnone,null\n")
    df = csv.read_csv(spark, [str(a)])
    assert df.schema["height"].dataType == T.LongType() and values(df, "height") == [0, 1, 2, None, None]
    b = write(tmp_path / "b.csv", 'id;name\n1;"x;y,z"\n2;plain\n')
    assert values(csv.read_csv(spark, [str(b)]), "name") == ["plain", "x;y,z"]
    c = write(tmp_path / "c.csv", 'id,name\n1,"x;y,z"\n')
    assert csv.read_csv(spark, [str(c)]).first()["name"] == "x;y,z"
    big = write(tmp_path / "big.csv", 'id;x;note\n9223372036854775807;9223372036854775808;"two\nlines; one ""cell"""\n9223372036854775806;1;plain\n')
    df = csv.read_csv(spark, [str(big)])
    assert values(df, "id") == [9223372036854775806, 9223372036854775807] and dict(df.dtypes)["x"] == "double"
    assert values(df, "note") == ["plain", 'two\nlines; one "cell"']
    d = write(tmp_path / "d.csv", "f;b;e\n1.5;true;None\n2;false;null\n")
    assert [f.dataType.simpleString() for f in csv.read_csv(spark, [str(d)]).schema] == ["double", "boolean", "string"]


def test_spec_beside_the_data(spark, tmp_path):
    data = write(tmp_path / "pos_one.csv", "x\n1\n2\n")
    assert specfiles.search([data]) is None and specfiles.spec_name([data]).name == "pos_one.spec.yaml"
    with pytest.raises(RuntimeError, match="no specification"):
        AnnotatedFrame.from_files(spark, [data])
    assert AnnotatedFrame.from_files(spark, [data], metadata_required=False).spec["x"].value_range == MinMax(1, 2)
    FrameSpec([ColumnSpec("x", unit="m")]).save_yaml(tmp_path / "pos_one.spec.yaml")
    (tmp_path / "pos_one_broken.spec.yaml").write_text("no: spec")
    found = AnnotatedFrame.from_files(spark, [data])
    assert found.spec["x"].unit == "m" and found.spec.annotations["source"].value == ["pos_one.csv"]
    other = write(tmp_path / "pos_two.csv", "x\n3\n")
    assert specfiles.spec_name([data, other]).name == "pos_.collection.spec.yaml"


def test_parquet_by_name_and_mixed_metadata(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "b long, a long").write.parquet(str(tmp_path / "one.parquet"))
    spark.createDataFrame([(3, 4)], "c long, b long").write.parquet(str(tmp_path / "two.parquet"))
    df = readers.read(spark, [tmp_path / "one.parquet", tmp_path / "two.parquet"])
    assert df.columns == ["a", "b", "c"] and values(df, "c") == [3, None]
    AnnotatedFrame(longs(spark, a=[9]), spec(a={"unit": "m"})).export(tmp_path / "three.parquet")
    mixed = AnnotatedFrame.from_files(spark, [tmp_path / "one.parquet", tmp_path / "three.parquet"])
    assert mixed.spec["a"].unit is None and mixed.spec["a"].value_range == MinMax(2, 9)


def test_reader_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="no files"):
        AnnotatedFrame.from_files(spark, [])
    with pytest.raises(FileNotFoundError):
        AnnotatedFrame.from_files(spark, [tmp_path / "none.csv"])
    a, b = write(tmp_path / "a.csv", "x\n1\n"), write(tmp_path / "b.parquet", "")
    with pytest.raises(ValueError, match="one kind"):
        AnnotatedFrame.from_files(spark, [a, b])
    with pytest.raises(ValueError, match="cannot be read"):
        readers.format_of("x.txt")
    h = write(tmp_path / "x.h5", "")
    with pytest.raises(RuntimeError, match="tables"):
        readers.read(spark, h)


@pytest.mark.parametrize("suffix", [".parquet", ".csv"])
def test_save_and_load(spark, tmp_path, suffix):
    f = AnnotatedFrame(longs(spark, x=[1, 2], y=[None, 3]), FrameSpec([ColumnSpec("x", unit="m"), ColumnSpec("y")], [Annotation("comment", "c")]))
    f.save(tmp_path / f"out{suffix}")
    back = AnnotatedFrame.from_files(spark, [tmp_path / f"out{suffix}"])
    assert back.spec["x"].unit == "m" and back.df.select("x", "y").exceptAll(f.df.select("x", "y")).isEmpty() and back.count() == 2


def test_single_file_export_has_a_footer(spark, tmp_path):
    f = AnnotatedFrame(longs(spark, x=[1]), spec(x={"unit": "m"}))
    f.export(tmp_path / "one.parquet", single_file=True)
    assert readers.FOOTER_KEY in pq.read_schema(tmp_path / "one.parquet").metadata
    assert AnnotatedFrame.from_files(spark, [tmp_path / "one.parquet"]).spec["x"].unit == "m"


def test_convert_csv(spark, tmp_path):
    a, b = write(tmp_path / "a.csv", "x\n1\n99\n"), write(tmp_path / "b.csv", "x\n2\n")
    out = writers.convert_csv(spark, [a, b], spec(x={"value_range": MinMax(0, 9)}), tmp_path / "out.parquet")
    assert values(out.df, "x") == [1, 2] and (tmp_path / "out.spec.yaml").exists()


def test_archives(tmp_path):
    inner, outer = tmp_path / "inner.zip", tmp_path / "outer.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("b.csv", "x\n1\n")
        z.writestr("skip.txt", "")
    with zipfile.ZipFile(outer, "w") as z:
        z.write(inner, "inner.zip")
        z.writestr("a.csv", "x\n2\n")
    with archive.expanded([outer], skip=lambda n: n.endswith(".txt")) as files:
        kept = list(files)
        assert [f.name for f in files] == ["a.csv", "b.csv"]
    assert not any(f.exists() for f in kept)
    bad = tmp_path / "bad.zip"
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../../evil.csv", "x")
    with pytest.raises(ValueError, match="out of the archive"), archive.expanded([bad]):
        pass
    with pytest.raises(FileNotFoundError), archive.expanded([tmp_path / "none.zip"]):
        pass


def test_join_where_against_loops(spark):
    mine, theirs = [(k, k % 3, k * 7 % 23) for k in range(40)], [(k, k % 4, k * 5 % 29) for k in range(30)]
    left, right = spark.createDataFrame(mine, "a long, g long, t long"), spark.createDataFrame(theirs, "b long, g long, t long")
    frame = AnnotatedFrame(left, FrameSpec(), Mode.IGNORE)
    pairs = lambda keep: sorted((*m, *o) for m in mine for o in theirs if keep(m, o))
    equal = frame.join_where(right, F.col("g") == F.col("g_right"), F.col("t") < F.col("t_right"))
    assert equal.columns == ["a", "g", "t", "b", "g_right", "t_right"]
    assert sorted(map(tuple, equal.collect())) == pairs(lambda m, o: m[1] == o[1] and m[2] < o[2])
    near = frame.join_where(right, F.col("a") != F.col("b"), within=("t", "t", 2, 1))
    assert sorted(map(tuple, near.collect())) == pairs(lambda m, o: m[0] != o[0] and m[2] - 2 <= o[2] <= m[2] + 1)
    assert "NestedLoop" not in near._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, frame.join_where(right, within=("t", "t", 0, 0)).collect())) == pairs(lambda m, o: m[2] == o[2])
    with pytest.raises(ValueError, match="needs a predicate"):
        frame.join_where(right)
