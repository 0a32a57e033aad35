"""Classification of numbers into the words the reports use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity(z: Column) -> Column:
    size = F.abs(z)
    return F.when(size >= 3.5, "high").when(size >= 2.5, "medium").otherwise("low")


def correlation_strength(r: Column) -> Column:
    size = F.abs(r)
    return (
        F.when(r.isNull() | (size < 0.1), "negligible")
        .when(size < 0.3, "weak")
        .when(size < 0.7, "moderate")
        .when(size < 0.9, "strong")
        .otherwise("very_strong")
    )


def correlation_direction(r: Column) -> Column:
    return F.when(F.abs(r) >= 0.1, F.when(r > 0, "positive").otherwise("negative"))


def movement(pct: Column, *, absent: str, rising: str = "rising", falling: str = "falling",
             stable: str = "stable") -> Column:
    """More than 5 % up or down, or steady; ``absent`` where there is no percentage."""
    return (
        F.when(pct.isNull(), absent)
        .when(pct > 5, rising)
        .when(pct < -5, falling)
        .otherwise(stable)
    )


def pm25_category(mean: Column) -> Column:
    return (
        F.when(mean <= 12, "good")
        .when(mean <= 35.4, "moderate")
        .when(mean <= 55.4, "unhealthy_sensitive")
        .when(mean <= 150.4, "unhealthy")
        .when(mean > 150.4, "very_unhealthy")
    )
