"""Deterministic pseudo-random values as pure functions of a cell number.

A cell number is turned into a pair of residues modulo a Mersenne prime, which two rounds of
squaring and cross-feeding scramble. Nothing but the cell number and the lane enters, so
a value does not depend on batches, partitions or machines. The quotient by the prime is mixed in as
well, so the sequence does not repeat after 2^31 cells. All products stay below 2^63.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.arith import int_div

# The modulus and the multipliers.
MODULUS = 2147483647
MUL_A = 48271
MUL_B = 69621
MUL_C = 16807
LANE_X = 1013904223
LANE_Z = 362437069

# Lanes keep draws for different purposes independent of each other.
VALUE_LANE = 0
MASK_LANE = 1
NOISE_LANE = 2
TARGET_LANE = 3
SAMPLE_LANE = 4

SCALE = 1.5


def start_pair(cell, lane: int, high):
    """The first pair of a cell; ``high`` is the cell number divided by the modulus.

    This and the next two functions are plain arithmetic: they take Spark columns, NumPy arrays or
    Python integers alike.
    """
    low = cell % MODULUS
    x = (low + high * MUL_A + (lane * LANE_X + 11)) % MODULUS
    z = (low * MUL_B + high * MUL_C + (lane + 1) * LANE_Z) % MODULUS
    return x, z


def next_pair(x, z, first: int, second: int):
    return ((x * x) % MODULUS * first + z + 13) % MODULUS, ((z * z) % MODULUS * second + x + 7) % MODULUS


def scrambled(cell, lane: int, high):
    x, z = start_pair(cell, lane, high)
    for first, second in ROUNDS:
        x, z = next_pair(x, z, first, second)
    return x, z


ROUNDS = ((MUL_A, MUL_B), (MUL_B, MUL_A), (MUL_A, MUL_C))


def uniform_of(x):
    """U[0, 1)."""
    return x / float(MODULUS)


def normal_of(x, z, lib=F):
    """N(0, 1) by the Box-Muller transform; ``lib`` supplies sqrt, log and cos."""
    return lib.sqrt(-2.0 * lib.log((x + 1) / 2147483648.0)) * lib.cos(6.283185307179586 * (z + 1) / 2147483648.0)


def with_pair(df, cell: Column, lane: int, name: str):
    """Add columns ``{name}_x`` and ``{name}_z`` holding the scrambled pair of ``cell``.

    The rounds are separate projections so that no round is evaluated twice; the whole chain still
    runs inside one generated function.
    """
    xn, zn = f"{name}_x", f"{name}_z"
    x, z = start_pair(cell, lane, int_div(cell, MODULUS))
    df = df.withColumns({xn: x, zn: z})
    for first, second in ROUNDS:
        x, z = next_pair(F.col(xn), F.col(zn), first, second)
        df = df.withColumns({xn: x, zn: z})
    return df


def target_coefficients(n_targets: int) -> list[float]:
    """One coefficient per target, a function of the target number alone."""
    pairs = [scrambled(t, TARGET_LANE, 0) for t in range(n_targets)]
    return [SCALE * normal_of(x, z, math) for x, z in pairs]


class Sql:
    """An SQL expression that the arithmetic above accepts, so that the same draws can be written as SQL text."""

    def __init__(self, text) -> None:
        self.text = str(text)

    def _op(self, other, op: str, swap: bool = False) -> Sql:
        a, b = self.text, other.text if isinstance(other, Sql) else str(other)
        return Sql(f"({b} {op} {a})" if swap else f"({a} {op} {b})")

    def __add__(self, other):
        return self._op(other, "+")

    def __radd__(self, other):
        return self._op(other, "+", True)

    def __mul__(self, other):
        return self._op(other, "*")

    def __rmul__(self, other):
        return self._op(other, "*", True)

    def __mod__(self, other):
        return self._op(other, "%")

    def __str__(self) -> str:
        return self.text


class Whole:
    """A NumPy array of integers that the arithmetic above accepts; remainders keep the sign, as they do in Spark and SQL."""

    def __init__(self, values) -> None:
        self.values = values

    def __add__(self, other):
        return Whole(self.values + getattr(other, "values", other))

    def __mul__(self, other):
        return Whole(self.values * getattr(other, "values", other))

    def __mod__(self, other):
        return Whole(np.fmod(self.values, other))


def sample_draw(cell, key: int):
    """A draw in [0, MODULUS) for a non-negative integer ``cell`` and a key (seed, round, tree) below 2**40.

    Columns, integers, ``Whole`` and ``Sql`` alike; both Spark and SQL engines keep every product below 2**63.
    """
    x, _ = start_pair(cell, SAMPLE_LANE, key)
    for first, second in ROUNDS:
        x, z = next_pair(x, _, first, second)
        _ = z
    return x
