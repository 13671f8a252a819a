"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The word pattern of the contracts and its separators.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"

_stored: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. A temporary one only where that is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once as a table in the shared folder and read it back.

    Unlike cached blocks the table survives lost executors, and unlike ``checkpoint()`` it is columnar, compressed
    and computed once. ``release()`` deletes the tables, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _stored.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the order of stored tables, for ``release``."""
    return len(_stored)


def release(since: int = 0, until: int | None = None) -> None:
    """Delete the stored tables written between two marks (by default all); call it once what uses them has been written."""
    gone, _stored[since:until] = _stored[since:until], []
    for spark, path in gone:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session has ended: what is on this machine can still go
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


atexit.register(release)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` names it.

    A plain column expression named inside a lambda is evaluated again for every element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS), "")


def one_key(name: str, taken: list[str]) -> str:
    """``name``, extended by underscores until no column of ``taken`` is called so (Spark ignores case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
