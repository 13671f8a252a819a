"""Reading files into frames, with the specification that comes with them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera import validation
from tessera.frame import AnnotatedFrame
from tessera.model.annotations import SOURCE, Annotation
from tessera.model.spec import FIELD_KEY, ColumnSpec, FrameSpec, Merge, Mode
from tessera.sources import specfiles
from tessera.sources.csv import read_csv
from tessera.sources.hdf5 import read_hdf5, read_hdf5_attributes, read_netcdf

# Suffixes by format, and the footer key under which exported files hold their specification.
FORMATS = {"parquet": (".parquet", ".pq"), "csv": (".csv",), "hdf5": (".h5", ".hdf", ".hdf5"), "netcdf": (".nc", ".netcdf", ".nc4", ".netcdf4")}
FOOTER_KEY = b"annotated_dataframe"


def format_of(path: str | Path) -> str:
    suffix = Path(path).suffix.lower()
    for name, suffixes in FORMATS.items():
        if suffix in suffixes:
            return name
    raise ValueError(f"Reader: '{suffix}' files cannot be read; known: {sorted(s for x in FORMATS.values() for s in x)}")


def read_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Schemas united by name, columns in order of name, absent ones null."""
    df = spark.read.option("mergeSchema", True).parquet(*paths)
    return df.select(*[validation.quoted(c) for c in sorted(df.columns)])


def united(frames: Sequence[DataFrame]) -> DataFrame:
    """The rows of all frames, columns matched by name and in order of name, absent ones null."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return df.select(*[validation.quoted(c) for c in sorted(df.columns)])


def read(spark: SparkSession, path: str | Path | Sequence[str | Path], sep: str | None = None) -> DataFrame:
    """Files of one kind as a DataFrame."""
    paths = [str(p) for p in (path if isinstance(path, (list, tuple)) else [path])]
    kind = format_of(paths[0])
    if kind == "csv":
        return read_csv(spark, paths, sep)
    return {"parquet": read_parquet, "hdf5": read_hdf5, "netcdf": read_netcdf}[kind](spark, paths)


def _local(path: str) -> bool:
    return "://" not in path


def _embedded(spark: SparkSession, path: str, kind: str) -> FrameSpec | None:
    """The specification inside a file: in field metadata, or in the footer of a single exported file."""
    if kind == "hdf5":
        found = read_hdf5_attributes(path)
        return FrameSpec([ColumnSpec(name, description=a.get("description"), unit=a.get("unit")) for name, a in found.items()]) if found else None
    if kind != "parquet":
        return None
    schema = spark.read.parquet(path).schema
    if any(FIELD_KEY in f.metadata for f in schema):
        return FrameSpec.from_schema(schema)
    if _local(path) and Path(path).is_file():
        import pyarrow.parquet as pq

        meta = pq.read_schema(path).metadata or {}
        if FOOTER_KEY in meta:
            return FrameSpec.from_dict(json.loads(meta[FOOTER_KEY]))
    return None


def load(spark: SparkSession, files: Sequence[str | Path], metadata_required: bool = True, mode: Mode = Mode.READONLY, strategy: Merge = Merge.THIS) -> AnnotatedFrame:
    """Files of one suffix as one annotated frame.

    The specification is the embedded one (of all files, merged from left to right), else a file found beside the data,
    else inferred from the data unless ``metadata_required``. If only some files have one embedded, it is inferred.
    """
    paths = [str(f) for f in files]
    if not paths:
        raise ValueError("Reader: no files are given")
    for path in paths:
        if _local(path) and not Path(path).exists():
            raise FileNotFoundError(f"Reader: no file {path}")
    if len({Path(p).suffix.lower() for p in paths}) != 1:
        raise ValueError(f"Reader: files of one kind are needed, got {sorted({Path(p).suffix for p in paths})}")
    kind = format_of(paths[0])
    df = read(spark, paths)
    embedded = [_embedded(spark, p, kind) for p in paths]
    if all(embedded):
        spec = embedded[0]
        for other in embedded[1:]:
            spec = spec.merge(other, strategy)
    elif any(embedded):
        return AnnotatedFrame(df, validation.infer(df), Mode.IGNORE)
    elif (found := specfiles.search(paths) if _local(paths[0]) else None) is not None:
        spec = FrameSpec.load_yaml(found)
    elif metadata_required:
        raise RuntimeError(f"Reader: no specification for {paths} in the files or beside them (like {specfiles.spec_name(paths).name})")
    else:
        return AnnotatedFrame(df, validation.infer(df), Mode.IGNORE)
    if SOURCE not in spec.annotations:
        spec = spec.add_annotation(Annotation(SOURCE, [Path(p).name for p in paths]))
    return AnnotatedFrame(df, spec, mode, strict_types=False)
