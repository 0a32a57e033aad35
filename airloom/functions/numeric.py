"""Rounding and ratio helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, places: int) -> Column:
    """Round half away from zero on the decimal reading of a double.

    The value first becomes a decimal of ten places, which drops the last-bit noise a distributed sum
    leaves behind, so the result does not depend on the order in which partitions were added up. NaN and
    infinities have no decimal reading and become NULL.
    """
    exact = value.cast("double").try_cast("decimal(38,10)")
    return F.round(exact, places).cast("double")


def round_exact(value: Column, places: int) -> Column:
    """Rounding of the exact binary value to one or two places, ties to even, as Python's ``round`` does.

    The decision at a midpoint m / (2 * 10^places) needs value * 2 * 10^places without rounding error, so
    the double is split into a high and a low half whose products with that factor are both exact.
    """
    scale = float(10 ** places)
    size = F.abs(value)
    shifted = size * F.lit(134217729.0)
    high = shifted - (shifted - size)
    low = size - high
    units = F.floor(size * scale).cast("double")
    side = (high * (2 * scale) - (units * 2.0 + 1.0)) + low * (2 * scale)
    rounded = (
        F.when(side > 0, units + 1.0)
        .when(side < 0, units)
        .otherwise(units + F.pmod(units, F.lit(2.0)))
    )
    return F.signum(value) * rounded / scale


def percent_change(current: Column, previous: Column, places: int | None = 2) -> Column:
    """Change in percent against a positive previous value; NULL where there is none."""
    change = (current - previous) / F.nullif(previous, F.lit(0.0)) * 100.0
    if places is not None:
        change = round_half_up(change, places)
    return F.when(previous > 0, change)


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    return (value - mean) / F.nullif(deviation, F.lit(0.0))


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows where both sides are present; NULL on zero variance or fewer than 2 rows."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_samp(F.when(both, a)) * F.stddev_samp(F.when(both, b))
    return F.covar_samp(a, b) / F.nullif(spread, F.lit(0.0))


def share_percent(part: Column, whole: Column) -> Column:
    """Part of a whole in percent with one place, 0 for an empty whole."""
    return F.when(whole > 0, round_exact(part / F.nullif(whole, F.lit(0)) * 100.0, 1)).otherwise(0.0)


def minutes_between(earlier: Column, later: Column) -> Column:
    """Minutes with one place."""
    return round_exact((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6) / 60.0, 1)
