"""Row selections shared by the analyses. Every one of them reaches the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.functions.times import day_literal, instant
from airloom.schemas import SUSPECT, VALID


def allowed_flags(include_suspect: bool = False) -> tuple[str, ...]:
    return (VALID, SUSPECT) if include_suspect else (VALID,)


def between_instants(df: DataFrame, since: datetime | None = None, until: datetime | None = None,
                     *, closed: bool = False) -> DataFrame:
    """Rows at or after ``since`` and before ``until`` (up to and including it with ``closed``).

    Where the table carries its ``reading_date`` partition column the same bounds are put on it, so whole
    directories are skipped.
    """
    moment, day = F.col("timestamp"), F.col("reading_date")
    dated = "reading_date" in df.columns
    bounds = []
    if since is not None:
        bounds.append(moment >= instant(since))
        if dated:
            bounds.append(day >= day_literal(since))
    if until is not None:
        bounds.append(moment <= instant(until) if closed else moment < instant(until))
        if dated:
            bounds.append(day <= day_literal(until))
    return df.where(reduce(and_, bounds)) if bounds else df


def select_series(df: DataFrame, city_ids: Sequence[str] | None = None,
                  parameters: Sequence[str] | None = None) -> DataFrame:
    """Narrow to the named cities and parameters; None keeps all."""
    if city_ids is not None:
        df = df.where(F.col("city_id").isin(list(city_ids)))
    if parameters is not None:
        df = df.where(F.col("parameter").isin(list(parameters)))
    return df


def usable_readings(readings: DataFrame, *, since: datetime | None = None, until: datetime | None = None,
                    city_ids: Sequence[str] | None = None, parameters: Sequence[str] | None = None,
                    include_suspect: bool = False) -> DataFrame:
    """The readings an analysis may use. There is no upper bound unless one is given."""
    flags = allowed_flags(include_suspect)
    kept = between_instants(readings, since, until).where(F.col("quality_flag").isin(list(flags)))
    return select_series(kept, city_ids, parameters)


def active(cities: DataFrame) -> DataFrame:
    return cities.where(F.col("is_active"))


def city_names(cities: DataFrame, *columns: str, active_only: bool = True) -> DataFrame:
    """city_id, city_name and further columns of the dimension, ready to join by ``city_id``."""
    kept = active(cities) if active_only else cities
    return kept.select(F.col("id").alias("city_id"), F.col("name").alias("city_name"), *columns)


def changed_since(df: DataFrame, moment: datetime) -> DataFrame:
    """Rows inserted or corrected after the last extraction."""
    return df.where(F.col("updated_at") > instant(moment))


def changed(new: Column, old: Column) -> Column:
    """Null-safe inequality."""
    return ~new.eqNullSafe(old)


def page(df: DataFrame, order: Sequence[str], skip: int = 0, limit: int = 100, after: Sequence | None = None) -> DataFrame:
    """A page by ``order``, whose columns hold no nulls. ``after`` gives the last row's values of the page before: each
    task then passes over what lies before and keeps ``limit`` rows, whatever the page's number. A large ``skip``
    passes through one task; ``positions.deep_page`` does without.
    """
    check_page(skip, limit)
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for name, value in zip(order, after, strict=True):
            beyond, same = beyond | (same & (F.col(name) > F.lit(value))), same & (F.col(name) == F.lit(value))
        df = df.where(beyond)
    return df.orderBy(*order).offset(skip).limit(limit)


def page_info(df: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """One row: how many rows there are in all and whether any follow this page."""
    check_page(skip, limit)
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(skip).alias("skip"), F.lit(limit).alias("limit"),
        (F.lit(skip + limit) < F.col("total")).alias("has_more"),
    )


def check_page(skip: int, limit: int) -> None:
    if skip < 0 or not 1 <= limit <= 1000:
        raise ValueError("skip must be at least 0 and limit between 1 and 1000")
