"""Units of measure: symbols, products and quotients, equality. Values are never converted by the engine."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fractions import Fraction

# Name or symbol -> (printed symbol, dimension, factor to the dimension's base).
_SYMBOLS = {
    "deg": ("deg", "angle", 0.017453292519943295),
    "degree": ("deg", "angle", 0.017453292519943295),
    "rad": ("rad", "angle", 1.0),
    "radian": ("rad", "angle", 1.0),
    "m": ("m", "length", 1.0),
    "meter": ("m", "length", 1.0),
    "metre": ("m", "length", 1.0),
    "cm": ("cm", "length", 0.01),
    "mm": ("mm", "length", 0.001),
    "km": ("km", "length", 1000.0),
    "kilometer": ("km", "length", 1000.0),
    "nmi": ("nmi", "length", 1852.0),
    "ms": ("ms", "time", 0.001),
    "s": ("s", "time", 1.0),
    "second": ("s", "time", 1.0),
    "min": ("min", "time", 60.0),
    "minute": ("min", "time", 60.0),
    "h": ("h", "time", 3600.0),
    "hr": ("h", "time", 3600.0),
    "hour": ("h", "time", 3600.0),
    "d": ("d", "time", 86400.0),
    "day": ("d", "time", 86400.0),
    "g": ("g", "mass", 0.001),
    "kg": ("kg", "mass", 1.0),
    "t": ("t", "mass", 1000.0),
    "K": ("K", "temperature", 1.0),
    "Pa": ("Pa", "pressure", 1.0),
    "hPa": ("hPa", "pressure", 100.0),
    "Hz": ("Hz", "frequency", 1.0),
    "V": ("V", "voltage", 1.0),
    "A": ("A", "current", 1.0),
    "W": ("W", "power", 1.0),
    "pct": ("%", "ratio", 0.01),
    "%": ("%", "ratio", 0.01),
}
_NAMED = {"knots": "nmi / h", "knot": "nmi / h", "kn": "nmi / h"}
_FACTOR = re.compile(r"([A-Za-z%]+)(?:\s*(?:\*\*|\^)\s*(-?\d+)|(-?\d+))?$")


@dataclass(frozen=True)
class Unit:
    """A product of symbols to powers; equal to any unit of the same size in every dimension."""

    powers: tuple[tuple[str, int], ...]
    text: str = field(default="", compare=False)

    @staticmethod
    def parse(text: str | Unit | None) -> Unit | None:
        if text is None or isinstance(text, Unit):
            return text
        found: dict[str, int] = {}
        for k, side in enumerate(_NAMED.get(text.strip(), text).split("/")):
            for factor in re.split(r"\s*[*.]\s*(?!\*)|\s+", side.strip().strip("()").replace("**", "^")):
                if factor in ("", "1"):
                    continue
                m = _FACTOR.match(factor)
                if m is None or m[1] not in _SYMBOLS and m[1] not in _NAMED:
                    raise ValueError(f"Unit: '{text}' is not known")
                power = int(m[2] or m[3] or 1) * (-1 if k else 1)
                parts = Unit.parse(_NAMED[m[1]]).powers if m[1] in _NAMED else ((_SYMBOLS[m[1]][0], 1),)
                for symbol, p in parts:
                    found[symbol] = found.get(symbol, 0) + p * power
        return Unit(tuple(sorted((s, p) for s, p in found.items() if p)), text.strip() if text.strip() in _NAMED else "")

    def _size(self) -> tuple[tuple[tuple[str, int], ...], float]:
        dimensions: dict[str, int] = {}
        size = 1.0
        for symbol, power in self.powers:
            _, dimension, factor = next(x for x in _SYMBOLS.values() if x[0] == symbol)
            dimensions[dimension] = dimensions.get(dimension, 0) + power
            size *= factor**power
        return tuple(sorted((d, p) for d, p in dimensions.items() if p)), size

    def __eq__(self, other: object) -> bool:
        if isinstance(other, str):
            other = Unit.parse(other)
        if not isinstance(other, Unit):
            return NotImplemented
        (d1, s1), (d2, s2) = self._size(), other._size()
        return d1 == d2 and abs(s1 - s2) <= 1e-9 * max(abs(s1), abs(s2))

    def __hash__(self) -> int:
        return hash(self._size()[0])

    def to_string(self) -> str:
        if self.text:
            return self.text
        show = lambda s, p: s if p == 1 else f"{s}{p}"
        over = " ".join(show(s, p) for s, p in self.powers if p > 0)
        under = [show(s, -p) for s, p in self.powers if p < 0]
        if not under:
            return over
        return f"{over or '1'} / {under[0] if len(under) == 1 else '(' + ' '.join(under) + ')'}"

    __str__ = to_string


def ratio(a: Unit, b: Unit) -> Fraction | float:
    """How many ``b`` make one ``a``; raises if their dimensions differ."""
    (d1, s1), (d2, s2) = a._size(), b._size()
    if d1 != d2:
        raise ValueError(f"Unit: {a} and {b} are of different kinds")
    return s1 / s2
