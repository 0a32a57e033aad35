"""Comparison and ranking of cities."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airloom.functions.numeric import percent_change, round_half_up
from airloom.functions.quality import canonical_unit
from airloom.functions.times import days_before, instant, to_utc
from airloom.operators.filters import city_names, usable_readings
from airloom.operators.positions import ranked
from airloom.plans.trend import check_days
from airloom.schemas import SERIES_KEY


def two_period_statistics(base: DataFrame, split: datetime, places: int, *, usable: Column | None = None,
                          extra: Sequence[Column] = ()) -> DataFrame:
    """Current statistics and the previous average per series, from one scan of both periods.

    Rows at or after ``split`` are current. A series without previous rows has a NULL ``prev_avg``; one
    without current rows has a ``reading_count`` of 0, and callers leave it out. ``usable`` narrows what is
    measured without narrowing what the ``extra`` aggregates see.
    """
    is_current = F.col("timestamp") >= instant(split)
    is_previous = ~is_current
    if usable is not None:
        is_current, is_previous = is_current & usable, is_previous & usable
    current = F.when(is_current, F.col("value"))
    return base.groupBy(*SERIES_KEY).agg(
        round_half_up(F.avg(current), places).alias("avg"),
        round_half_up(F.min(current), places).alias("min"),
        round_half_up(F.max(current), places).alias("max"),
        F.count_if(is_current).alias("reading_count"),
        round_half_up(F.avg(F.when(is_previous, F.col("value"))), places).alias("prev_avg"),
        *extra,
    )


def compare(readings: DataFrame, cities: DataFrame, *, as_of: datetime | str | None = None, days: int = 7,
            city_ids: Sequence[str] | None = None, city_set: DataFrame | None = None,
            parameters: Sequence[str] | None = None, include_suspect: bool = False,
            until: datetime | None = None, sort: bool = True) -> DataFrame:
    """Cities side by side per parameter: rank by rounded average, change against the period before.

    Inactive cities take part. ``city_set`` (a frame with city_id) serves selections too long for
    ``city_ids``. Ranks are counted in slices, so a parameter may have any number of cities.
    """
    check_days(days)
    if city_ids is not None and len(set(city_ids)) < 2:
        raise ValueError("a comparison needs at least two cities")
    now = to_utc(as_of)
    base = usable_readings(readings, since=days_before(now, 2 * days), until=until, city_ids=city_ids,
                           parameters=parameters, include_suspect=include_suspect)
    if city_set is not None:
        base = base.join(city_set.select("city_id"), "city_id", "left_semi")
    statistics = two_period_statistics(base, days_before(now, days), 4).where(F.col("reading_count") > 0)
    named = statistics.join(city_names(cities, active_only=False), "city_id")
    result = ranked(named, ["parameter"], "avg").select(
        "parameter", canonical_unit(F.col("parameter")).alias("unit"), F.lit(days).alias("days"), "city_id",
        "city_name", "avg", "min", "max", "reading_count",
        "rank",
        percent_change(F.col("avg"), F.col("prev_avg")).alias("pct_change_vs_prev_period"),
    )
    return result.orderBy("parameter", "rank", "city_id") if sort else result


def ranking(readings: DataFrame, cities: DataFrame, *, as_of: datetime | str | None = None, days: int = 7,
            parameters: Sequence[str] | None = None, country: str | None = None, limit: int | None = 10,
            min_readings: int = 10, include_suspect: bool = False, until: datetime | None = None,
            sort: bool = True) -> DataFrame:
    """Active cities per parameter from the lowest average up, ranked on the unrounded average.

    Cities with fewer than ``min_readings`` readings do not take part. With a ``limit``, each task keeps
    its own best before the shuffle; ``None`` ranks every city, in slices.
    """
    check_days(days)
    if limit is not None and not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    now = to_utc(as_of)
    base = usable_readings(readings, since=days_before(now, days), until=until, parameters=parameters,
                           include_suspect=include_suspect)
    averages = base.groupBy(*SERIES_KEY).agg(
        F.avg("value").alias("mean"), F.max("timestamp").alias("data_freshness"),
        F.count(F.lit(1)).alias("reading_count"),
    ).where(F.col("reading_count") >= min_readings)
    names = city_names(cities, "country_code")
    if country is not None:
        names = names.where(F.col("country_code") == F.upper(F.lit(country)))
    placed = averages.join(names, "city_id")
    if limit is None:
        placed = ranked(placed, ["parameter"], "mean")
    else:
        listed = W.partitionBy("parameter").orderBy(F.col("mean").asc_nulls_last(), "city_id")
        placed = placed.withColumn("listed", F.row_number().over(listed)).where(F.col("listed") <= limit)
        by_mean = W.partitionBy("parameter").orderBy(F.col("mean").asc_nulls_last())  # ``limit`` rows at most
        placed = placed.withColumn("rank", F.rank().over(by_mean).cast("long"))
    result = placed.select(
        "parameter", canonical_unit(F.col("parameter")).alias("unit"),
        F.lit(country.upper() if country else None).cast("string").alias("country"), F.lit(days).alias("days"),
        "city_id", "city_name", round_half_up(F.col("mean"), 4).alias("avg_value"),
        "rank", "data_freshness", "reading_count",
    )
    return result.orderBy("parameter", "rank", "city_id") if sort else result
