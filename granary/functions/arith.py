"""Integer helpers shared by the other modules."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column | int) -> Column:
    """Truncating integer division in BIGINT."""
    return F.call_function("div", a.cast("bigint"), F.lit(b).cast("bigint"))


def ceil_div(a: Column, b: Column | int) -> Column:
    """Integer division rounded up, for a non-negative ``a``."""
    b = F.lit(b).cast("bigint")
    return int_div(a.cast("bigint") + b - F.lit(1), b)


def int_fraction(n: Column, fraction: float) -> Column:
    """``int(n * fraction)``: the product is taken in double and truncated."""
    return (n.cast("double") * F.lit(float(fraction))).cast("bigint")


def count_at_most(value: Column, cuts: Sequence[Any]) -> Column:
    """How many of the ascending ``cuts`` are <= ``value``; NULL counts as below all.

    A halving search: a few comparisons per row for thousands of cuts, for any orderable type.
    """
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(c) for c in cuts])
    step, steps = 1, []
    while step <= len(cuts):
        steps.append(step)
        step *= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]),
        F.lit(0),
        lambda at, jump: F.when(F.get(table, at + jump - 1) <= value, at + jump).otherwise(at),
    )
