"""Archives of data files, expanded for as long as they are needed."""

from __future__ import annotations

import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path


def _expand(path: Path, into: Path, skip: Callable[[str], bool]) -> list[Path]:
    out = []
    with zipfile.ZipFile(path) as z:
        for member in z.infolist():
            target = (into / member.filename).resolve()
            if member.is_dir() or skip(member.filename):
                continue
            if not target.is_relative_to(into.resolve()):
                raise ValueError(f"Archive: '{member.filename}' in {path} leads out of the archive")
            target.parent.mkdir(parents=True, exist_ok=True)
            with z.open(member) as source, target.open("wb") as sink:
                shutil.copyfileobj(source, sink)
            if zipfile.is_zipfile(target):
                out += _expand(target, target.with_name(target.name + ".d"), skip)
            else:
                out.append(target)
    return out


@contextmanager
def expanded(files: Sequence[str | Path], folder: str | Path | None = None, skip: Callable[[str], bool] = lambda name: False) -> Iterator[list[Path]]:
    """Data files, sorted: zip files (also nested ones) are extracted and removed at the end, others pass as they are.

    ``folder`` must be one that executors share when there is more than one machine.
    """
    top = Path(tempfile.mkdtemp(prefix="tessera-archive-", dir=folder))
    try:
        out = []
        for k, path in enumerate(map(Path, files)):
            if not path.exists():
                raise FileNotFoundError(f"Archive: no file {path}")
            out += _expand(path, top / str(k), skip) if zipfile.is_zipfile(path) else [] if skip(path.name) else [path]
        yield sorted(out)
    finally:
        shutil.rmtree(top, ignore_errors=True)
