"""Basis functions of the encoding model, as array columns built from expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A bump's half width in spacings of the centers.
WIDTH = 1.5


def _bumps(u: Column, centers: list[float], width: float) -> Column:
    """Raised cosines (1 + cos) / 2 of u about the centers, 0 farther than width."""
    bump = lambda c: F.when(F.abs(u - c) <= width, 0.5 * (1 + F.cos((u - c) * (math.pi / width)))).otherwise(F.lit(0.0))
    return F.array(*(bump(c) for c in centers))


def raised_cosine(x: Column, n: int, low: float, high: float, shift: float = 0.5) -> Column:
    """n raised cosines of log(x + shift), centers evenly from low to high, each 1.5 spacings wide to either side."""
    a, b = math.log(low + shift), math.log(high + shift)
    spacing = (b - a) / max(1, n - 1)
    return _bumps(F.log(F.greatest(x, F.lit(0.0)) + shift), [a + k * spacing for k in range(n)], WIDTH * spacing)


def onset_kernel(t: Column, n: int, duration: float) -> Column:
    """n raised cosines of the time since onset up to duration; all 0 before onset."""
    spacing = duration / max(1, n - 1)
    bumps = _bumps(t, [k * spacing for k in range(n)], WIDTH * spacing)
    return F.when(t < 0, F.array(*[F.lit(0.0)] * n)).otherwise(bumps)


def products(a: Column, b: Column) -> Column:
    """Interaction terms: all products of two bases' values, b's changing fastest."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def dummies(x: Column, levels: list) -> Column:
    """Indicators of all levels but the first."""
    return F.array(*(F.when(x == v, 1.0).otherwise(0.0) for v in levels[1:]))
