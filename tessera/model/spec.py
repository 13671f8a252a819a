"""Column and frame specifications: what a column must be, and what is known about a frame."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum
from pathlib import Path

import yaml
from pyspark.sql import types as T

from tessera.model import types as types_
from tessera.model.annotations import Annotation, History
from tessera.model.ranges import ListOfValues, MinMax, Range, from_dict
from tessera.model.stats import ColumnStats
from tessera.model.units import Unit

#: Key under which a column's specification travels in the metadata of its Spark field.
FIELD_KEY = "spec"


class Category(str, Enum):
    DYNAMIC = "dynamic"
    STATIC = "static"


class Mode(str, Enum):
    """What to do where data and specification disagree."""

    IGNORE = "ignore"
    READONLY = "readonly"
    UPDATE_DATA = "update_data"
    UPDATE_METADATA = "update_metadata"


class Merge(str, Enum):
    """Whose value wins where two specifications disagree; NONE: it is an error."""

    NONE = "none"
    THIS = "this"
    OTHER = "other"


def _number(key: object) -> object:
    """Keys of JSON objects are text; meanings belong to values."""
    if isinstance(key, str):
        for kind in (int, float):
            try:
                return kind(key)
            except ValueError:
                pass
    return key


def _plain(value: object) -> object:
    """As YAML holds it: keys as they are, anything unknown as text."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value if value is None or type(value) in (bool, int, float, str) else str(value)


_MERGEABLE = (ListOfValues, MinMax, ColumnStats)


@dataclass
class ColumnSpec:
    """The contract of one column. Every field but the name may be left open."""

    name: str
    description: str | None = None
    category: Category | None = None
    is_optional: bool = False
    abbreviation: str | None = None
    representation_type: T.DataType | None = None
    missing_value: object = None
    precision: float | None = None
    unit: Unit | None = None
    value_range: Range | None = None
    value_stats: ColumnStats | None = None
    value_meanings: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.representation_type is not None:
            self.representation_type = types_.resolve(self.representation_type)
        if isinstance(self.category, str):
            self.category = Category(self.category)
        self.unit = Unit.parse(self.unit)
        if self.value_meanings:
            if self.value_range is None:
                raise ValueError(f"ColumnSpec: meanings of '{self.name}' need a range")
            for value in self.value_meanings:
                if value not in self.value_range:
                    raise ValueError(f"ColumnSpec: {value!r} has a meaning but is outside of the range of '{self.name}'")

    def but(self, **changes: object) -> ColumnSpec:
        return replace(self, **changes)

    # -- persistence ---------------------------------------------------------------------------------------------------

    def to_dict(self) -> dict:
        out: dict = {"name": self.name, "is_optional": self.is_optional}
        for key in ("description", "abbreviation", "missing_value", "precision"):
            if getattr(self, key) is not None:
                out[key] = getattr(self, key)
        if self.category is not None:
            out["category"] = self.category.value
        if self.representation_type is not None:
            out["representation_type"] = types_.show(self.representation_type)
        if self.unit is not None:
            out["unit"] = self.unit.to_string()
        if self.value_range is not None:
            out["value_range"] = self.value_range.to_dict()
        if self.value_stats is not None:
            out["value_stats"] = self.value_stats.to_dict()
        if self.value_meanings:
            out["value_meanings"] = dict(self.value_meanings)
        return out

    @staticmethod
    def from_dict(data: dict) -> ColumnSpec:
        for key in ("name", "is_optional"):
            if key not in data:
                raise KeyError(f"ColumnSpec: '{key}' is missing")
        kind = types_.resolve(data["representation_type"]) if data.get("representation_type") is not None else None
        convert = (lambda v: types_.to_python(kind, v)) if kind is not None else (lambda v: v)
        stats = data.get("value_stats")
        if stats is not None and kind is not None and types_.is_string(kind):
            stats = None
        return ColumnSpec(
            name=data["name"],
            is_optional=data["is_optional"],
            description=data.get("description"),
            category=data.get("category"),
            abbreviation=data.get("abbreviation"),
            representation_type=kind,
            missing_value=convert(data.get("missing_value")) if kind is not None else None,
            precision=data.get("precision") if kind is not None else None,
            unit=data.get("unit"),
            value_range=from_dict(data["value_range"], convert) if data.get("value_range") else None,
            value_stats=ColumnStats.from_dict(stats) if stats else None,
            value_meanings={_number(convert(k)): v for k, v in (data.get("value_meanings") or {}).items()} if kind is None or not types_.is_string(kind) else dict(data.get("value_meanings") or {}),
        )

    def to_field_metadata(self) -> dict:
        return {FIELD_KEY: json.dumps(self.to_dict(), default=str)}

    @staticmethod
    def from_field(f: T.StructField) -> ColumnSpec | None:
        text = f.metadata.get(FIELD_KEY)
        return ColumnSpec.from_dict(json.loads(text) | {"name": f.name}) if text else None

    # -- contracts -----------------------------------------------------------------------------------------------------

    def unfulfilled(self, given: ColumnSpec, containment: bool = False) -> list[str]:
        """Fields of this requirement that ``given`` does not meet. Open fields ask nothing.

        ``containment``: a range is also met by a narrower one.
        """
        failing = []
        for key in ("category", "representation_type", "missing_value", "precision", "unit", "value_range", "abbreviation"):
            wanted, have = getattr(self, key), getattr(given, key)
            if wanted is None:
                continue
            if key == "precision":
                ok = have is not None and wanted >= have
            elif key == "representation_type":
                ok = have is not None and types_.matches(have, wanted, strict=False)
            elif key == "value_range" and containment and isinstance(wanted, MinMax) and isinstance(have, MinMax):
                ok = wanted.covers(have)
            else:
                ok = wanted == have
            if not ok:
                failing.append(key)
        return failing

    def merge(self, other: ColumnSpec, strategy: Merge = Merge.NONE) -> ColumnSpec:
        """Both specifications in one: equal or single values stay, ranges and statistics are merged, else the strategy."""
        if self.name != other.name:
            raise ValueError(f"ColumnSpec: '{self.name}' and '{other.name}' are different columns")
        merged: dict = {}
        for key in self.__dataclass_fields__:
            a, b = getattr(self, key), getattr(other, key)
            if b is None or b == {} or a == b:
                merged[key] = a
            elif a is None or a == {}:
                merged[key] = b
            elif isinstance(a, _MERGEABLE) and isinstance(b, _MERGEABLE):
                merged[key] = a.merge(b)
            elif key == "value_meanings" and all(a.get(k, v) == v for k, v in b.items()):
                merged[key] = a | b
            elif key == "is_optional":
                merged[key] = a and b if strategy is Merge.NONE else (a if strategy is Merge.THIS else b)
            elif strategy is Merge.NONE:
                raise ValueError(f"ColumnSpec: '{self.name}' has two values for {key}: {a!r} and {b!r}")
            else:
                merged[key] = a if strategy is Merge.THIS else b
        return ColumnSpec(**merged)


class FrameSpec:
    """Column specifications, sorted by name, and annotations of the whole frame."""

    def __init__(self, columns: Iterable[ColumnSpec] = (), annotations: Iterable[Annotation] | dict[str, Annotation] = ()):
        self.columns = sorted(columns, key=lambda c: c.name)
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise ValueError("FrameSpec: a column is specified twice")
        items = list(annotations.values() if isinstance(annotations, dict) else annotations)
        if len({a.name for a in items}) != len(items):
            raise ValueError("FrameSpec: annotations need unique names")
        self.annotations = {a.name: a for a in items}

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def __contains__(self, name: str) -> bool:
        return name in self.column_names

    def __getitem__(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"FrameSpec: no column '{name}'")

    def get(self, name: str) -> ColumnSpec | None:
        return self[name] if name in self else None

    def __eq__(self, other: object) -> bool:
        return isinstance(other, FrameSpec) and self.columns == other.columns and self.annotations == other.annotations

    __hash__ = None

    def __repr__(self) -> str:
        return f"FrameSpec({self.column_names})"

    def with_columns(self, *specs: ColumnSpec) -> FrameSpec:
        new = {s.name for s in specs}
        return FrameSpec([*(c for c in self.columns if c.name not in new), *specs], self.annotations)

    def renamed(self, names: dict[str, str]) -> FrameSpec:
        return FrameSpec([c.but(name=names.get(c.name, c.name)) for c in self.columns], self.annotations)

    def drop(self, names: Sequence[str], strict: bool = True) -> FrameSpec:
        for name in names:
            if strict and name not in self:
                raise KeyError(f"FrameSpec: no column '{name}' to drop")
        return FrameSpec([c for c in self.columns if c.name not in names], self.annotations)

    def select(self, names: Sequence[str]) -> FrameSpec:
        return FrameSpec([c for c in self.columns if c.name in names], self.annotations)

    def add_annotation(self, annotation: Annotation) -> FrameSpec:
        return FrameSpec(self.columns, {**self.annotations, annotation.name: annotation})

    def unfulfilled(self, given: FrameSpec, containment: bool = False) -> dict[str, list[str]]:
        """Per column of this requirement what ``given`` lacks; an optional column may be missing."""
        out: dict[str, list[str]] = {}
        for wanted in self.columns:
            have = given.get(wanted.name)
            if have is None:
                if not wanted.is_optional:
                    out[wanted.name] = ["missing"]
            elif failing := wanted.unfulfilled(have, containment):
                out[wanted.name] = failing
        return out

    def merge(self, other: FrameSpec, strategy: Merge = Merge.NONE) -> FrameSpec:
        """The union of both: common columns and annotations are merged, others taken as they are."""
        columns = [c.merge(other[c.name], strategy) if c.name in other else c for c in self.columns]
        columns += [c for c in other.columns if c.name not in self]
        notes = dict(self.annotations)
        for name, note in other.annotations.items():
            notes[name] = notes[name].merge(note) if name in notes else note
        return FrameSpec(columns, notes)

    # -- persistence ---------------------------------------------------------------------------------------------------

    def to_dict(self) -> dict:
        notes: dict = {}
        for note in self.annotations.values():
            notes |= note.to_dict()
        return {"columns": [c.to_dict() for c in self.columns], "annotations": notes}

    @staticmethod
    def from_dict(data: dict) -> FrameSpec:
        if "columns" not in data:
            raise KeyError("FrameSpec: 'columns' is missing")
        notes = [Annotation.from_dict({k: v}) for k, v in (data.get("annotations") or {}).items()]
        return FrameSpec([ColumnSpec.from_dict(c) for c in data["columns"]], notes)

    def save_yaml(self, path: str | Path) -> None:
        Path(path).write_text(yaml.safe_dump(_plain(self.to_dict()), sort_keys=False, allow_unicode=True))

    @staticmethod
    def load_yaml(path: str | Path) -> FrameSpec:
        with open(path) as f:
            return FrameSpec.from_dict(yaml.safe_load(f))

    @staticmethod
    def from_schema(schema: T.StructType) -> FrameSpec:
        """What the fields' metadata carries, and name and type of the fields that carry nothing."""
        specs = [ColumnSpec.from_field(f) or ColumnSpec(f.name, representation_type=f.dataType) for f in schema]
        return FrameSpec(specs)


__all__ = ["Category", "ColumnSpec", "FrameSpec", "History", "Merge", "Mode"]
