"""Statistics of a numeric column, mergeable without the data."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class ColumnStats:
    """Mean, sample standard deviation, count of non-null values, count of nulls."""

    mean: float
    stddev: float
    total_count: int
    null_count: int = 0

    def merge(self, other: ColumnStats) -> ColumnStats:
        """Statistics of both parts together: pooled mean and variance."""
        n, m = self.total_count, other.total_count
        if not n or not m:
            rest = other if not n else self
            return ColumnStats(rest.mean, rest.stddev, n + m, self.null_count + other.null_count)
        mean = (n * self.mean + m * other.mean) / (n + m)
        squares = (n - 1) * self.stddev**2 + (m - 1) * other.stddev**2 + n * m / (n + m) * (self.mean - other.mean) ** 2
        return ColumnStats(mean, math.sqrt(squares / (n + m - 1)), n + m, self.null_count + other.null_count)

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(data: dict) -> ColumnStats:
        return ColumnStats(**{k: data[k] for k in ("mean", "stddev", "total_count", "null_count")})
