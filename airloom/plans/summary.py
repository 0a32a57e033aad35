"""Report-level summaries built on the analyses."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airloom.functions.labels import movement, pm25_category
from airloom.functions.numeric import percent_change, round_exact, round_half_up
from airloom.functions.quality import canonical_unit
from airloom.functions.times import days_before, to_utc
from airloom.operators.filters import city_names, usable_readings
from airloom.operators.sites import resolve_names
from airloom.plans.anomalies import _parts, deviates, with_scores
from airloom.plans.compare import compare
from airloom.plans.trend import bucket_statistics, check_days
from airloom.schemas import ANOMALY_PARAMETERS, SERIES_KEY, SUMMARY_PARAMETERS

SHOWN_ANOMALIES = 10


def air_quality_summary(readings: DataFrame, cities: DataFrame, *, as_of: datetime | str | None = None,
                        days: int = 7, parameters: Sequence[str] = SUMMARY_PARAMETERS,
                        city_ids: Sequence[str] | None = None) -> DataFrame:
    """Per city and parameter: mean of the daily means, overall range, first-to-last-day trend, PM2.5 class."""
    check_days(days)
    base = usable_readings(readings, since=days_before(to_utc(as_of), days), parameters=parameters,
                           city_ids=city_ids)
    series = bucket_statistics(base, "day").groupBy(*SERIES_KEY).agg(
        F.avg("avg").alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.min_by("avg", "period").alias("first_avg"), F.max_by("avg", "period").alias("last_avg"),
        F.sum("reading_count").alias("reading_count"),
    )
    change = percent_change(F.col("last_avg"), F.col("first_avg"), places=None)
    category = F.when(F.col("parameter") == "pm25", pm25_category(F.col("mean")))
    return series.join(city_names(cities), "city_id").select(
        "city_id", "city_name", "parameter", canonical_unit(F.col("parameter")).alias("unit"),
        round_half_up(F.col("mean"), 4).alias("overall_avg"), "min", "max",
        round_exact(change, 1).alias("pct_change"),
        movement(change, absent="insufficient_baseline").alias("trend"), category.alias("aqi_category"),
        "reading_count",
    )


def compare_summary(readings: DataFrame, cities: DataFrame, requests: DataFrame | None = None, *,
                    parameter: str = "pm25", as_of: datetime | str | None = None) -> DataFrame:
    """Seven-day comparison with the direction of change in words.

    ``requests`` (request_seq, requested_name) limits it to the cities these names resolve to; names that
    resolve to none come from ``unresolved_names``.
    """
    chosen = None
    if requests is not None:
        chosen = resolve_names(cities, requests).where(F.col("city_id").isNotNull())
    rows = compare(readings, cities, as_of=as_of, days=7, parameters=[parameter], city_set=chosen, sort=False)
    direction = movement(F.col("pct_change_vs_prev_period"), absent="n/a", rising="up", falling="down", stable="flat")
    return rows.withColumn("trend", direction).orderBy("rank", "city_id")


def anomaly_summary(readings: DataFrame, cities: DataFrame, *, as_of: datetime | str | None = None,
                    sensitivity: float = 2.0, parameters: Sequence[str] = ANOMALY_PARAMETERS) -> DataFrame:
    """Thirty days of pollutant anomalies per active city: counts by severity and the ten most extreme.

    A city without anomalies is reported with zeros and an empty list.
    """
    _, scored = _parts(readings, to_utc(as_of), 30, None, list(parameters), False, None)
    found = with_scores(scored.where(deviates(sensitivity)))
    listed = F.array_position(F.array(*[F.lit(p) for p in parameters]), F.col("parameter"))
    extreme_first = [F.abs("z_score").desc(), listed, F.col("size").desc(), "timestamp"]
    # Two levels, so that neither counting nor ranking puts all anomalies of a city in one place and the
    # baselines are evaluated once: every hour of a series keeps its ten most extreme readings, the first
    # of them also the hour's counts, and a city then has at most ten rows per series and hour.
    hour = W.partitionBy(*SERIES_KEY, F.date_trunc("hour", "timestamp"))
    levels = ("high", "medium", "low")
    by_hour = (
        found.withColumn("in_hour", F.row_number().over(hour.orderBy(*extreme_first)))
        .withColumns({level: F.count_if(F.col("severity") == level).over(hour) for level in levels})
        .where(F.col("in_hour") <= SHOWN_ANOMALIES)
    )
    entry = F.struct("position", "parameter", canonical_unit(F.col("parameter")).alias("unit"), "timestamp",
                     "value", "rolling_avg", "z_score", "severity")
    city = by_hour.withColumn("position", F.row_number().over(W.partitionBy("city_id").orderBy(*extreme_first)))
    reported = city.groupBy("city_id").agg(
        *[F.sum(F.when(F.col("in_hour") == 1, F.col(level))).alias(level) for level in levels],
        F.array_sort(F.collect_list(F.when(F.col("position") <= SHOWN_ANOMALIES, entry))).alias("top_anomalies"),
    ).withColumn("total", F.col("high") + F.col("medium") + F.col("low"))
    zero = F.lit(0).cast("long")
    return city_names(cities).join(reported, "city_id", "left").select(
        "city_id", "city_name", *[F.coalesce(name, zero).alias(name) for name in ("total", *levels)],
        F.coalesce("top_anomalies", F.array().cast(reported.schema["top_anomalies"].dataType)).alias("top_anomalies"),
    )
