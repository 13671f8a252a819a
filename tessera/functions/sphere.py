"""Places on the earth as unit vectors, and the cubes of a grid in which they lie."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

_AXES = "xyz"


def vector(lat: Column, lon: Column) -> Column:
    """A struct x, y, z of length 1."""
    p, q = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(p) * F.cos(q)).alias("x"), (F.cos(p) * F.sin(q)).alias("y"), F.sin(p).alias("z"))


def square(a: Column, b: Column) -> Column:
    """The squared chord between two vectors."""
    x, y, z = ((a[n] - b[n]) * (a[n] - b[n]) for n in _AXES)
    return x + y + z


def _steps(v: Column, edge: float) -> list[Column]:
    return [F.floor(v[n] / F.lit(float(edge))).cast("long") for n in _AXES]


def _key(steps: list[Column]) -> Column:
    """One number of three steps of 21 bits each; edges down to a millionth have steps of a million at most."""
    x, y, z = (s + F.lit(1 << 20) for s in steps)
    return F.shiftleft(x, 42).bitwiseOR(F.shiftleft(y, 21)).bitwiseOR(z)


def cube(v: Column, edge: float) -> Column:
    """The cube of a vector, as a number."""
    return _key(_steps(v, edge))


def around(v: Column, edge: float) -> Column:
    """The 27 cubes in which anything within ``edge`` of the vector lies."""
    steps = _steps(v, edge)
    return F.array(*[_key([s + F.lit(d) for s, d in zip(steps, shift, strict=True)]) for shift in product((-1, 0, 1), repeat=3)])


def reached(v: Column, distance: float) -> Column:
    """The cubes with an edge of twice ``distance`` in which vectors within ``distance`` can lie: eight at most.

    Of the two cubes that are reached along each axis, those stay that the ball around the vector and the sphere both meet,
    as a rule four or five.
    """
    edge = 2.0 * distance
    total = lambda sides, name: sides[0][name] + sides[1][name] + sides[2][name]

    def pair(x: Column) -> Column:
        """The two steps of an axis, with the least distance to x and the least and greatest to 0, squared."""
        squared = lambda value, name: (value * value).alias(name)
        first = F.floor((x - F.lit(distance)) / F.lit(edge)).cast("long")

        def side(step: Column) -> Column:
            low, high = step * F.lit(edge), (step + F.lit(1)) * F.lit(edge)
            gap, least, most = F.greatest(low - x, x - high, F.lit(0.0)), F.greatest(low, -high, F.lit(0.0)), F.greatest(high, -low)
            return F.struct(step.alias("step"), squared(gap, "gap"), squared(least, "least"), squared(most, "most"))

        return F.transform(F.sequence(first, first + F.lit(1)), side)

    def met(*sides: Column) -> Column:
        on = (total(sides, "least") <= 1 + 1e-9) & (total(sides, "most") >= 1 - 1e-9)
        return (total(sides, "gap") <= F.lit(distance * distance)) & on

    def keys(axes: Column) -> Column:
        of_two = lambda a, b: F.transform(F.filter(axes["z"], lambda c: met(a, b, c)), lambda c: _key([a["step"], b["step"], c["step"]]))
        return F.flatten(F.transform(axes["x"], lambda a: F.flatten(F.transform(axes["y"], lambda b: of_two(a, b)))))

    # Functions of arrays: the eight terms written out are more than the JVM compiles. In an array so that axes are computed once.
    return F.flatten(F.transform(F.array(F.struct(*[pair(v[n]).alias(n) for n in _AXES])), keys))


def centre(name: str, edge: float) -> Column:
    """The middle of a cube that is given as a number."""
    step = lambda at: F.shiftright(F.col(name), at).bitwiseAND(F.lit((1 << 21) - 1)) - F.lit(1 << 20)
    return F.struct(*[((step(at) + 0.5) * F.lit(float(edge))).alias(n) for n, at in zip(_AXES, (42, 21, 0), strict=True)])


def chord(angle: float) -> float:
    """The chord of an angle in radians."""
    return 2 * math.sin(min(math.pi, angle) / 2)
