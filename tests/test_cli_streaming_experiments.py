import datetime as dt

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from tessera import cli, experiments
from tessera.frame import AnnotatedFrame
from tessera.model.spec import ColumnSpec, FrameSpec, Mode
from tessera.operators.augment import MultiplyValue
from tessera.plans.pipeline import Pipeline
from tessera.streaming import positions


@pytest.fixture
def data(tmp_path):
    path = tmp_path / "data.csv"
    path.write_text("height;letter\n1;a\n2;b\n30;None\n")
    return path


def test_inspect(spark, data, capsys):
    assert cli.main(["inspect", "-f", str(data), "--filter", "height < 10", "--head", "5", "--tail", "1", "--columns", "height"]) == 0
    said = capsys.readouterr().out
    assert "height:" in said and "'max': 2" in said and "letter" not in said


def test_errors_exit_with_one(spark, tmp_path, capsys):
    assert cli.main(["inspect", "-f", str(tmp_path / "none.csv")]) == 1
    assert "FileNotFoundError" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["nonsense"])


def test_annotate_convert_and_process(spark, data, tmp_path, capsys):
    assert cli.main(["annotate", "-f", str(data), "-o", str(tmp_path), "--set-unit", "height:m", "--set-description", "letter:a letter"]) == 0
    spec = FrameSpec.load_yaml(tmp_path / "data.spec.yaml")
    assert spec["height"].unit == "m" and spec["letter"].description == "a letter"
    assert cli.main(["convert", "-f", str(data), "-o", str(tmp_path / "out.parquet")]) == 0
    assert AnnotatedFrame.from_files(spark, [tmp_path / "out.parquet"]).spec["height"].unit == "m"
    (tmp_path / "each").mkdir()
    assert cli.main(["convert", "-f", str(data), "--output-dir", str(tmp_path / "each"), "-m", str(tmp_path / "data.spec.yaml")]) == 0
    assert (tmp_path / "each" / "data.parquet").exists()
    p = Pipeline("double", validation="off").add("twice", MultiplyValue(2), {"x": "height"})
    assert cli.main(["process", "-f", str(tmp_path / "out.parquet"), "--pipeline", str(p.save(tmp_path)), "-o", str(tmp_path / "done.parquet")]) == 0
    assert sorted(r["height"] for r in spark.read.parquet(str(tmp_path / "done.parquet")).collect()) == [2, 4, 60]
    assert cli.main(["annotate", "-f", str(tmp_path / "out.parquet"), "--inplace", "--set-unit", "height:km"]) == 0
    again = AnnotatedFrame.from_files(spark, [tmp_path / "out.parquet"])
    assert again.spec["height"].unit == "km" and again.count() == 3
    assert cli.main(["annotate", "-f", str(data), "--set-unit", "nope:m"]) == 1
    capsys.readouterr()
    assert cli.main(["plugins"]) == 0
    assert "RemoveValueRows" in capsys.readouterr().out


def test_deltas_across_micro_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    batches = [[(1, 0, 0.0, 0.0), (1, 60, 0.0, 1.0), (2, 5, 50.0, 5.0)], [(1, 180, 0.0, 2.0), (2, 65, 50.0, 5.0)]]
    schema = "g long, t timestamp, lat double, lon double"
    for k, rows in enumerate(batches):
        made = [(g, start + dt.timedelta(seconds=s), a, b) for g, s, a, b in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = positions.deltas(stream, "g", "t", "lat", "lon").writeStream.format("memory").queryName("deltas").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {(r["g"], int((r["t"] - start).total_seconds())): r for r in spark.table("deltas").collect()}
    assert len(rows) == 5 and rows[(1, 0)]["delta_time"] is None
    degree = 6373 * np.pi / 180
    assert rows[(1, 180)]["delta_time"] == 120 and rows[(1, 180)]["delta_distance"] == pytest.approx(degree)
    assert rows[(1, 60)]["speed"] == pytest.approx(degree * 60) and rows[(2, 65)]["delta_distance"] == 0


def test_activity_windows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(minutes=m)) for m in (0, 1, 11, 12, 13)]
    spark.createDataFrame(rows, "g long, t timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g long, t timestamp").parquet(str(tmp_path / "in"))
    q = positions.activity(stream, "g", "t").writeStream.format("memory").queryName("activity").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("activity").collect()) == [2, 3]


def track(spark):
    rows = [(g, float(t), float(2 * t + g)) for g in range(20) for t in range(12)]
    df = spark.createDataFrame(rows, "mmsi long, timestamp double, x double")
    return AnnotatedFrame(df, FrameSpec([ColumnSpec(c) for c in df.columns]), Mode.IGNORE)


def test_experiment(spark, tmp_path):
    task = experiments.ForecastTask(
        "forecast", Pipeline("double", validation="off").add("twice", MultiplyValue(2), {"x": "x"}), ["x"], ["x"],
        ["tessera.experiments.LastValue", "tessera.experiments.LinearForecast"], "mmsi", 4, 2,
    )
    e = experiments.Experiment(task, "unused", str(tmp_path), ratios=[0.6, 0.2, 0.2], seed=1)
    e.save(tmp_path / "e.yaml")
    assert experiments.Experiment.load(tmp_path / "e.yaml").to_dict() == e.to_dict()
    report = e.run(spark, track(spark))
    last, linear = (report["models"][m]["evaluation"]["test"] for m in ("LastValue", "LinearForecast"))
    assert last["windows"] == linear["windows"] == 4 * 7 and linear["mse"] < 1e-6 < last["mse"]
    folder = next(p for p in tmp_path.iterdir() if p.is_dir())
    assert {p.name for p in folder.iterdir()} == {
        "double.tessera.ppl", "LinearForecast.npy", "report.yaml", "evaluation.csv", "LastValue.history.csv", "LinearForecast.history.csv",
    }
    assert yaml.safe_load((folder / "report.yaml").read_text())["task"] == "forecast"
    with pytest.raises(ValueError, match="no group column"):
        experiments.Experiment(experiments.ForecastTask("f", Pipeline("p"), ["x"], ["x"], group_column="zzz"), "", str(tmp_path / "b")).run(spark, track(spark))
    with pytest.raises(ValueError, match="only forecast"):
        experiments.ForecastTask.from_dict({"class_name": "Other"})


def test_scores_on_executors(spark):
    model = experiments.LastValue("last", ["x"], ["x"], 3, 2)
    out = experiments.score_batches(track(spark).df, ["timestamp"], model, "mmsi")
    assert out.count() == 20 * 10
    r = out.where("mmsi = 1 and start = 0").first()
    assert r["prediction"] == [5.0, 5.0] and out.agg(F.max("start")).first()[0] == 9
