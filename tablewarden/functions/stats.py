"""Aggregate expressions that stay safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def pair_correlation(a: Column, b: Column, complete: bool = False) -> Column:
    """Pearson correlation over rows where both sides are present.

    NULL when either side is constant. ``complete`` promises that neither side has
    missing values, so the spreads need no pairwise mask and are shared between pairs.
    """
    left, right = (a, b) if complete else (F.when(b.isNotNull(), a), F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_samp(left, right), F.stddev_samp(left) * F.stddev_samp(right))


SPREAD_TOLERANCE = 1e-12


def pair_sums(x: Column, y: Column, key: str, aggs: list[Column]) -> list[Column]:
    """Append the six sums over rows where both are present; returns them as columns."""
    both = x.isNotNull() & y.isNotNull()
    sums = {
        "n": F.count(F.when(both, F.lit(1))),
        "x": F.sum(F.when(both, x)),
        "y": F.sum(F.when(both, y)),
        "xx": F.sum(F.when(both, x * x)),
        "yy": F.sum(F.when(both, y * y)),
        "xy": F.sum(x * y),
    }
    aggs += [v.alias(f"{k}_{key}") for k, v in sums.items()]
    return [F.col(f"{k}_{key}") for k in sums]


def correlation_from_sums(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """Pearson correlation from sums of roughly centred values; NULL if a side is constant."""
    left = xx - F.try_divide(x * x, n)
    right = yy - F.try_divide(y * y, n)
    varies = (left > SPREAD_TOLERANCE * xx) & (right > SPREAD_TOLERANCE * yy)
    return F.when(varies, F.try_divide(xy - F.try_divide(x * y, n), F.sqrt(left * right)))


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def n_log_n(n: Column) -> Column:
    """n·ln(n) with 0 at n = 0, the building block of count entropies."""
    return F.when(n > 0, n * F.ln(n)).otherwise(F.lit(0.0))
