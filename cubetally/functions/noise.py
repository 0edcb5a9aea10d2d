"""Noise as columns: Laplace by inverse distribution, randomized response, one-hot encodings.

Every function takes its uniforms as columns.  ``fresh`` gives independent streams for real use; the hash
uniforms of ``functions.hashing`` replay noise in tests.  ``sensitivity`` is how many cells one record can
change, and scales the noise: with a region sketch that is updates a row times depth.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def fresh(seed: int | None = None) -> Column:
    return F.rand(seed) if seed is not None else F.rand()


def laplace(u: Column, scale: float) -> Column:
    """Inverse distribution function at a uniform in (0, 1)."""
    v = u - 0.5
    return -F.lit(scale) * F.signum(v) * F.ln(1 - 2 * F.abs(v))


def flip_chance(epsilon: float) -> float:
    return 1 / (math.exp(epsilon) + 1)


def keep_chance(epsilon: float, values: int) -> float:
    """Chance to report the true one of ``values`` values."""
    return math.exp(epsilon) / (math.exp(epsilon) + values - 1)


def response(true: Column, u: Column, v: Column, epsilon: float, width: int) -> Column:
    """The true cell with ``keep_chance``, else one of the other width - 1, chosen by ``v``."""
    other = F.least(F.floor(v * (width - 1)).cast("long"), F.lit(width - 2).cast("long"))
    return F.when(u < keep_chance(epsilon, width), true).otherwise(other + F.when(other >= true, 1).otherwise(0))


def debiased(count: Column, n: Column, p: float, q: float) -> Column:
    return (count - n * q) / (p - q)


def hadamard_sign(i: Column, j: Column) -> Column:
    """Entry of the Hadamard matrix of any power of two: -1 to the number of common one bits."""
    return F.when(F.bit_count(i.bitwiseAND(j)) % 2 == 0, 1).otherwise(-1)


def power_schedule(start: float, end: float, n: int, gamma: float) -> Column:
    """array<double>: n values from start to end along a power curve."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (end - start) * F.pow(i / max(1, n - 1), gamma))
