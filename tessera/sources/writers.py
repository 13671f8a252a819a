"""Writing frames with their specification."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.frame import AnnotatedFrame
from tessera.model.spec import FrameSpec, Mode
from tessera.sources.csv import read_csv, write_csv
from tessera.sources.hdf5 import write_hdf5
from tessera.sources.specfiles import SUFFIX


def save(frame: AnnotatedFrame, path: str | Path) -> None:
    """Data and ``<stem>.spec.yaml`` beside it. The suffix says the format: .csv, .h5/.hdf5, else Parquet.

    CSV and Parquet are written by all executors, as a folder of that name.
    """
    from tessera.sources.readers import FORMATS

    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    frame.spec.save_yaml(path.with_name(path.stem + SUFFIX))
    if path.suffix in FORMATS["hdf5"]:
        attributes = {c.name: {k: str(v) for k, v in (("unit", c.unit), ("description", c.description)) if v is not None} for c in frame.spec.columns}
        write_hdf5(frame.df, str(path), attributes=attributes)
    elif path.suffix == ".csv":
        write_csv(frame.df, str(path))
    else:
        frame.annotated.write.mode("overwrite").parquet(str(path))


def export(frame: AnnotatedFrame, path: str | Path, single_file: bool = False) -> None:
    """Parquet that carries its specification: in field metadata, or, as one file made on the driver, in the footer."""
    if not single_file:
        frame.annotated.write.mode("overwrite").parquet(str(path))
        return
    import pyarrow.parquet as pq

    from tessera.sources.readers import FOOTER_KEY

    table = frame.df.toArrow()
    spec = json.dumps(frame.spec.to_dict(), default=str).encode()
    pq.write_table(table.replace_schema_metadata({**(table.schema.metadata or {}), FOOTER_KEY: spec}), str(path))


def convert_csv(spark: SparkSession, files: Sequence[str | Path], spec: FrameSpec | str | Path, output: str | Path, mode: Mode = Mode.UPDATE_DATA) -> AnnotatedFrame:
    """CSV files and a specification as one saved, annotated dataset."""
    spec = spec if isinstance(spec, FrameSpec) else FrameSpec.load_yaml(spec)
    frame = AnnotatedFrame(read_csv(spark, sorted(map(str, files))), spec, mode, strict_types=False)
    save(frame, output)
    return frame
