"""Finding the specification file that belongs to data files."""

from __future__ import annotations

import os
from collections.abc import Sequence
from difflib import SequenceMatcher
from pathlib import Path

from tessera.model.spec import FrameSpec

SUFFIX = ".spec.yaml"


def _common(files: Sequence[str | Path]) -> tuple[Path, str]:
    """The folder and the beginning of the name that all files share."""
    paths = [Path(f) for f in files]
    folder = Path(os.path.commonpath([p.parent for p in paths]))
    return folder, os.path.commonprefix([p.stem for p in paths])


def spec_name(files: Sequence[str | Path]) -> Path:
    """Where the specification of these files is kept."""
    if len(files) == 1:
        path = Path(files[0])
        return path.with_name(path.stem + SUFFIX)
    folder, prefix = _common(files)
    return folder / f"{prefix}.collection{SUFFIX}"


def search(files: Sequence[str | Path]) -> Path | None:
    """The loadable specification beside the files whose name is most like theirs."""
    folder, prefix = _common(files)
    like = lambda p: SequenceMatcher(None, p.name.removesuffix(SUFFIX), prefix).ratio()
    for path in sorted(folder.glob(f"{prefix}*{SUFFIX}"), key=like, reverse=True):
        try:
            FrameSpec.load_yaml(path)
        except Exception:  # noqa: BLE001 - not a specification: the next best one
            continue
        return path
    return None
