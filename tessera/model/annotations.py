"""Provenance of a whole frame: named annotations and a history of changes."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# The annotation keys with a meaning of their own.
INSTITUTION, LICENSE, REFERENCES, SOURCE, HISTORY, COMMENT = "institution", "license", "references", "source", "history", "comment"


@dataclass
class Annotation:
    name: str
    value: object = None

    def __post_init__(self) -> None:
        if self.name in (LICENSE, COMMENT) and not self.value:
            raise ValueError(f"Annotation: '{self.name}' must not be empty")

    def to_dict(self) -> dict:
        return {self.name: self.value}

    @staticmethod
    def from_dict(data: dict) -> Annotation:
        if len(data) != 1:
            raise ValueError("Annotation: a single key is needed")
        name, value = next(iter(data.items()))
        return History([Change.from_dict(c) for c in value or []]) if name == HISTORY else Annotation(name, value)

    def merge(self, other: Annotation) -> Annotation:
        if self.value == other.value:
            return self
        mine = self.value if isinstance(self.value, list) else [self.value]
        return Annotation(self.name, mine + [v for v in (other.value if isinstance(other.value, list) else [other.value]) if v not in mine])


@dataclass
class Change:
    """One step of a history. The time is that of the call unless given, zone-aware, in whole seconds."""

    title: str
    description: str = ""
    timestamp: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc))

    def __post_init__(self) -> None:
        if self.timestamp.tzinfo is None:
            raise ValueError("Change: the timestamp needs a time zone")
        self.timestamp = self.timestamp.replace(microsecond=0)

    def to_dict(self) -> dict:
        return {"title": self.title, "description": self.description, "timestamp": self.timestamp.isoformat()}

    @staticmethod
    def from_dict(data: dict) -> Change:
        stamp = data["timestamp"]
        stamp = dt.datetime.fromisoformat(stamp) if isinstance(stamp, str) else stamp
        return Change(data["title"], data.get("description", ""), stamp if stamp.tzinfo else stamp.replace(tzinfo=dt.timezone.utc))


class History(Annotation):
    """Changes in order of their text form."""

    def __init__(self, changes: list[Change] | None = None):
        super().__init__(HISTORY, [])
        for change in changes or []:
            self.add_change(change)

    @property
    def changes(self) -> list[Change]:
        return self.value

    def add_change(self, change: Change) -> None:
        self.value = sorted([*self.value, change], key=lambda c: str(c.to_dict()))

    def merge(self, other: Annotation) -> History:
        return History(self.value + [c for c in other.value if c not in self.value])

    def to_dict(self) -> dict:
        return {HISTORY: [c.to_dict() for c in self.value]}
