import warnings

import pytest
from pyspark.sql import functions as F

from tessera.frame import AnnotatedFrame
from tessera.model.ranges import MinMax
from tessera.model.spec import ColumnSpec, FrameSpec, Mode
from tessera.operators.augment import CycleTransformer, MultiplyValue
from tessera.operators.filters import DropMissingOrNan, FilterRange
from tessera.operators.joins import JoinByTimestamp
from tessera.operators.timeseries import AddDeltaTime
from tessera.plans import plugins
from tessera.plans.pipeline import Graph, Node, Pipeline
from tessera.plans.step import Step, artifacts, check_requirement, describe, input, output


class Add(Step):
    """x + n in y."""

    def __init__(self, n: int = 1):
        self.n = n

    @describe("add")
    @input({"x": {"unit": "m"}})
    @output({"y": {"unit": "m", "value_range": MinMax(0, 100)}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        return df._with(df.withColumn(self.get_name("y"), F.col(self.get_name("x")) + self.n), df.spec)


class Plus(Step):
    """a + n in b."""

    def __init__(self, n: int = 1):
        self.n = n

    @input({"a": {"unit": "m"}})
    @output({"b": {"unit": "m"}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        return df._with(df.withColumn(self.get_name("b"), F.col(self.get_name("a")) + self.n), df.spec)


class Lose(Step):
    @input({"x": {}})
    @output({})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        return df._with(df.df.drop("x"), df.spec.drop(["x"]))


class Forget(Step):
    @input({"x": {}})
    @output({"q": {}})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        return df


class Nothing(Step):
    @input({"x": {}})
    @output({})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        pass


class WriteFile(Step):
    def __init__(self, name: str = "a.txt"):
        self.name = name

    @input({"x": {}})
    @output({})
    @artifacts({"text": "*.txt"})
    def transform(self, df: AnnotatedFrame) -> AnnotatedFrame:
        if self.name:
            from pathlib import Path

            (Path(self.base_dir) / self.name).write_text("x")
        return df


def frame(spark, *specs, rows=((1, 2), (3, 4))):
    df = spark.createDataFrame(list(rows), "x long, t long")
    own = FrameSpec([ColumnSpec("x", unit="m", representation_type=int), ColumnSpec("t", representation_type=int)])
    return AnnotatedFrame(df, own.with_columns(*specs), Mode.IGNORE)


def test_contracts(spark):
    f = frame(spark)
    out = Add(5).transform(f)
    assert out.spec["y"].unit == "m" and out.select("y").first()[0] == 6
    with pytest.raises(RuntimeError, match="not fulfilled"):
        Add().transform(frame(spark, ColumnSpec("x", unit="s")))
    with pytest.raises(RuntimeError, match="lost the columns"):
        Lose().transform(f)
    with pytest.raises(RuntimeError, match="did not make"):
        Forget().transform(f)
    with pytest.raises(RuntimeError, match="returned nothing"):
        Nothing().transform(f)
    with pytest.raises(KeyError, match="twice"):
        input({})(input({})(lambda self, df: df))
    with pytest.raises(RuntimeError, match="annotated to return"):

        @output({})
        def transform(self, df):
            return df


def test_names():
    s = CycleTransformer(2).map_names({"x": "a", "a": "b"}).map_names({"k": "kk"}, "other")
    assert s.get_name("x") == "b" and s.get_name("{{x}}_x") == "b_x" and s.get_name("{{other:k}}_1") == "kk_1" and s.get_name("z") == "z"
    assert s.output_spec().column_names == ["b_x", "b_y"]


def test_pipeline_runs_and_checks(spark):
    p = Pipeline("two", observe=True).add("one", Add(1)).add("two", Plus(2), {"a": "y", "b": "z"})
    out = p.transform(frame(spark))
    assert sorted(map(tuple, out.df.collect())) == [(1, 2, 2, 4), (3, 4, 4, 6)]
    assert [s.rows for s in p.stats] == [2, 2]
    assert p.check({"df": frame(spark).spec}).column_names == ["t", "x", "y", "z"]
    wrong = Pipeline("wrong").add("two", Plus(2), {"a": "y", "b": "z"}).add("one", Add(1))
    spark.sparkContext.setJobGroup("static", "")
    with pytest.raises(RuntimeError, match="not fulfilled"):
        wrong.transform(frame(spark))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("static")
    spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("mode", ["deferred", "eager"])
def test_outputs_are_validated(spark, mode):
    with pytest.raises((ValueError, RuntimeError), match="lie outside of range"):
        Pipeline("p", validation=mode).add("far", Add(1000)).transform(frame(spark))
    assert Pipeline("p", validation="off").add("far", Add(1000)).transform(frame(spark)).count() == 2


def test_errors_name_the_step(spark):
    with pytest.raises(RuntimeError, match=r"Pipeline 'p': step 1 'lose' \(Lose\)"):
        Pipeline("p").add("lose", Lose()).transform(frame(spark))


def test_prepare_redirects_names(spark):
    df = spark.createDataFrame([(1,)], "length long")
    f = AnnotatedFrame(df, FrameSpec([ColumnSpec("length", unit="m")]), Mode.IGNORE)
    p = Pipeline("p", validation="off").add("one", Add(1), {"x": "height"})
    own = p.prepare(f, height="length")
    assert own.transform(f).columns == ["length", "y"]
    assert p.steps[0][1].get_name("x") == "height"
    with pytest.raises(TypeError, match="AnnotatedFrame"):
        p.prepare(df)


def test_joins_in_the_graph(spark):
    other = AnnotatedFrame(spark.createDataFrame([(2, 10), (9, 11)], "at long, v long"), mode=Mode.IGNORE)
    step = lambda: JoinByTimestamp().map_names({"timestamp": "t"}).map_names({"timestamp": "at"}, "other")
    p = Pipeline("j", validation="off").add("one", Add(1)).join("times", step(), "other")
    assert p.sources == ["df", "other"]
    out = p.transform(frame(spark), other=other)
    assert list(map(tuple, out.df.select("x", "v").collect())) == [(1, 10)]
    with pytest.raises(KeyError, match="no data"):
        p.transform(frame(spark))
    with pytest.raises(ValueError, match="several inputs"):
        Pipeline("x").add("times", step())
    with pytest.raises(ValueError, match="exactly two"):
        Pipeline("x").join("one", Add())
    sub = Pipeline("sub", validation="off").add("double", MultiplyValue(2), {"x": "v"})
    out = Pipeline("k", validation="off").join("times", step(), sub).transform(frame(spark), other=other)
    assert out.df.select("v").first()[0] == 20


def test_pipelines_in_pipelines(spark):
    inner = Pipeline("inner", validation="off").add("one", Add(1))
    outer = Pipeline("outer", validation="off").add("inner", inner).add("two", Plus(1), {"a": "y", "b": "z"})
    assert outer.transform(frame(spark)).columns == ["x", "t", "y", "z"]


def test_save_and_load(spark, tmp_path):
    step = JoinByTimestamp().map_names({"timestamp": "t"}).map_names({"timestamp": "at"}, "other")
    p = Pipeline("saved", "text", base_dir=str(tmp_path)).add("range", FilterRange(0, 3), {"x": "x"}).join("times", step, "other")
    path = p.save(tmp_path)
    back = Pipeline.load(path)
    assert back.to_dict() == p.to_dict() and Pipeline.load(tmp_path).to_dict() == p.to_dict()
    other = AnnotatedFrame(spark.createDataFrame([(2, 10), (4, 11)], "at long, v long"), mode=Mode.IGNORE)
    assert list(map(tuple, back.transform(frame(spark), other=other).select("x", "v").collect())) == [(1, 10), (3, 11)]
    Pipeline("saved2").add("drop", DropMissingOrNan()).save(tmp_path)
    with pytest.raises(FileNotFoundError, match="2 matches"):
        Pipeline.load(tmp_path)
    with pytest.raises(FileNotFoundError):
        Pipeline.load(tmp_path / "none.tessera.ppl")
    assert "times" in p.text() and "in other" in p.text()


def test_state(spark, tmp_path):
    p = Pipeline("s", validation="off").add("one", Add(1))
    p.save_state(p.transform(frame(spark)), tmp_path / "state")
    again, data = Pipeline.load_state(spark, tmp_path / "state")
    assert again.to_dict() == p.to_dict() and data.spec["y"].unit == "m" and data.count() == 2


def test_artifacts(spark, tmp_path):
    Pipeline("a", base_dir=tmp_path).add("write", WriteFile()).transform(frame(spark))
    with pytest.raises(RuntimeError, match="is missing"):
        Pipeline("a", base_dir=tmp_path / "none").add("write", WriteFile("")).transform(frame(spark))


def test_graph_order_and_cycles():
    g = Graph()
    g.add(Node("a", Add(), {"df": "df"}))
    with pytest.raises(ValueError, match="there already"):
        g.add(Node("a", Add(), {"df": "df"}))
    with pytest.raises(ValueError, match="not there"):
        g.add(Node("b", Add(), {"df": "zzz"}))
    g.nodes["a"].slots["df"] = "a"
    with pytest.raises(ValueError, match="cycle"):
        g.order()


def test_requirements():
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        check_requirement("tessera==0.1.0")
        check_requirement("pyspark>=3.0")
        check_requirement("pyspark")
    with pytest.warns(UserWarning, match="was saved"):
        check_requirement("pyspark==1.0")
    with pytest.raises(RuntimeError, match="pip install"):
        check_requirement("no-such-library==1")


def test_unsaveable_parameters():
    class Bad(Step):
        def __init__(self, n):
            self.other = n

    with pytest.raises(AttributeError, match="must be an attribute"):
        Bad(1).to_dict()


def test_plugins(tmp_path, monkeypatch):
    code = "from tessera.plans.step import Step\nclass {}(Step):\n    pass\n"
    (tmp_path / "a.py").write_text(code.format("PluginStep"))
    (tmp_path / "b.py").write_text(code.format("PluginStep"))
    (tmp_path / "c.py").write_text("raise OSError")
    monkeypatch.setenv(plugins.PATH_VARIABLE, str(tmp_path))
    with pytest.warns(UserWarning) as told:
        found = plugins.discover(reload=True)
    assert found["PluginStep"][0].endswith("a.py")
    assert {"hidden" in str(w.message) or "cannot be loaded" in str(w.message) for w in told} == {True}
    kind = plugins.find("PluginStep")
    assert Step.from_dict(kind().to_dict()) == kind()
    assert any("PluginStep" in x for x in plugins.listing())
    with pytest.raises(ImportError):
        plugins.find("NoSuchStep")
    monkeypatch.delenv(plugins.PATH_VARIABLE)
    plugins.discover(reload=True)


def test_one_exchange_for_a_group(spark):
    f = frame(spark)
    p = Pipeline("w", validation="off").add("a", AddDeltaTime(), {"group": "x", "time_column": "t", "delta_time": "d1"}).add("b", AddDeltaTime(), {"group": "x", "time_column": "t"})
    plan = p.transform(f).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_verbose_shows_a_row_of_every_step(spark, capsys):
    frame = AnnotatedFrame(spark.createDataFrame([(1,), (2,)], "x long"), FrameSpec([ColumnSpec("x", unit="m")]))
    pipeline = Pipeline("shown", observe=True).add("one", Add(10)).add("two", Add(20))
    out = pipeline.transform(frame, verbose=True)
    said = capsys.readouterr().out
    assert said.index("shown: one") < said.index("|  1| 11|") < said.index("shown: two") < said.index("|  1| 21|")
    assert "only showing top 1 row" in said and [s.rows for s in pipeline.stats] == [None, None]
    assert sorted(map(tuple, out.df.collect())) == [(1, 21), (2, 22)]
    pipeline.transform(frame).df.collect()
    assert capsys.readouterr().out == "" and [s.rows for s in pipeline.stats] == [2, 2]
