"""HDF5 and NetCDF, through optional libraries: files are read on executors, one file a task."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def _needs(name: str, what: str):
    import importlib

    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise RuntimeError(f"{what} needs the library '{name}': pip install {name}") from e


def _by_file(spark: SparkSession, paths: list[str], load) -> DataFrame:
    """One row of schema from the first file on the driver, then every file in a task of its own."""
    schema = spark.createDataFrame(load(paths[0]).head(1)).schema

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            for path in frame["path"]:
                yield load(path)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path").mapInPandas(run, schema)


def read_hdf5(spark: SparkSession, paths: list[str], key: str | None = None) -> DataFrame:
    """The pandas layout; a file in columnar layout (/table/columns) is recognised and read column by column."""
    _needs("tables", "HDF5")

    def load(path: str):
        import pandas as pd
        import tables

        with tables.open_file(path) as f:
            if "/table/columns" in f:
                columns = f.get_node("/table/columns")
                return pd.DataFrame({n._v_name: n.data.read() for n in columns._f_iter_nodes()})
        return pd.read_hdf(path, key=key)

    return _by_file(spark, paths, load)


def read_hdf5_attributes(path: str) -> dict[str, dict]:
    """Attributes of each column of the columnar layout, as far as they are there: units and descriptions."""
    tables = _needs("tables", "HDF5")
    with tables.open_file(path) as f:
        if "/table/columns" not in f:
            return {}
        nodes = f.get_node("/table/columns")._f_iter_nodes()
        return {n._v_name: {k: n._v_attrs[k] for k in n._v_attrs._v_attrnamesuser} for n in nodes}


def write_hdf5(df: DataFrame, path: str, key: str = "dataframe", attributes: dict[str, dict] | None = None, overwrite: bool = True) -> None:
    """A single file, written on the driver: for results that fit it."""
    tables = _needs("tables", "HDF5")
    df.toPandas().to_hdf(path, key=key, mode="w" if overwrite else "a")
    with tables.open_file(path, "a") as f:
        root = f.get_node(f"/{key}")
        for column, values in (attributes or {}).items():
            for name, value in values.items():
                label = f"{column}.{name}"
                if label in root._v_attrs and root._v_attrs[label] != value and not overwrite:
                    raise RuntimeError(f"HDF5: attribute '{label}' is there with another value")
                root._v_attrs[label] = value


def read_netcdf(spark: SparkSession, paths: list[str]) -> DataFrame:
    _needs("xarray", "NetCDF")

    def load(path: str):
        import xarray

        with xarray.open_dataset(path) as data:
            return data.to_dataframe().reset_index()

    return _by_file(spark, paths, load)
