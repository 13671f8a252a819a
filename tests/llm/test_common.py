from pathlib import Path

import pytest
from llm_data import ODD
from pyspark.sql import functions as F

from tessera.llm import common


def test_stored_tables_are_in_the_shared_folder_and_released(make, spark):
    docs = make(ODD)
    kept = common.stored(docs, "test")
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "tessera"
    assert kept.count() == len(ODD) and kept.columns == docs.columns and any(p.name.startswith("test-") for p in folder.iterdir())
    common.release()
    assert not any(folder.iterdir()) and common._stored == []


def test_words(make):
    out = {r[0]: r[1] for r in make(ODD).select("doc_id", common.words(F.col("text"))).collect()}
    assert [out[k] for k in (0, 1, 2, 3, 9)] == [[], [], [], ["one"], ["a", "b", "c", "d"]]


def test_let_evaluates_once(spark):
    calls = spark.range(1).select(common.let(F.rand(), lambda x: F.array(x, x))).first()[0]
    assert calls[0] == calls[1]


@pytest.mark.parametrize(("taken", "name"), [([], "a"), (["a"], "a_"), (["A", "a_"], "a__")])
def test_one_key(taken, name):
    assert common.one_key("a", taken) == name
