"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A temporary one only where that is unset and all runs on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it is deleted when the driver ends."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage: ``df`` as a table in the shared folder, computed once. It survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete all tables written here; call it once the results that use them have been stored."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session has ended: what is on this machine can still go
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


atexit.register(release)
