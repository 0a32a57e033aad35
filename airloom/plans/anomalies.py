"""Rolling z-score anomalies."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.functions.labels import severity
from airloom.functions.numeric import round_half_up, z_score
from airloom.functions.quality import canonical_unit
from airloom.functions.times import days_before, instant, to_utc
from airloom.operators.filters import city_names, usable_readings
from airloom.operators.rolling import BLOCK_FRAMES, framed, placed_rows
from airloom.plans.trend import check_days
from airloom.schemas import SERIES_KEY

MIN_PRECEDING = 24
WARM_UP_DAYS = 7


def check_sensitivity(sensitivity: float) -> None:
    if not 1.0 <= sensitivity <= 5.0:
        raise ValueError("sensitivity must be between 1 and 5")


def deviates(sensitivity: float) -> Column:
    """A filled enough frame, some spread in it, and an unrounded z-score at or beyond the threshold."""
    z = z_score(F.col("value"), F.col("rolling_avg"), F.col("rolling_stddev"))
    return (
        (F.col("window_size") >= MIN_PRECEDING)
        & (F.col("rolling_stddev") > 0)
        & (F.abs(z) >= F.lit(float(sensitivity)))
    )


def with_scores(scored: DataFrame, places: int = 4) -> DataFrame:
    """Rounded baseline and z-score, the severity of the rounded score, and the exact size for ordering."""
    z = z_score(F.col("value"), F.col("rolling_avg"), F.col("rolling_stddev"))
    return scored.select(
        *SERIES_KEY, "timestamp", "value",
        round_half_up(F.col("rolling_avg"), places).alias("rolling_avg"),
        round_half_up(F.col("rolling_stddev"), places).alias("rolling_stddev"),
        round_half_up(z, places).alias("z_score"), F.abs(z).alias("size"),
    ).withColumn("severity", severity(F.col("z_score")))


def _parts(readings: DataFrame, now: datetime, days: int, city_ids, parameters, include_suspect: bool,
           until: datetime | None, block_frames: int = BLOCK_FRAMES) -> tuple[DataFrame, DataFrame]:
    analysis = days_before(now, days)
    base = usable_readings(readings, since=days_before(analysis, WARM_UP_DAYS), until=until, city_ids=city_ids,
                           parameters=parameters, include_suspect=include_suspect)
    base = base.select(*SERIES_KEY, "timestamp", "value").where(
        F.col("city_id").isNotNull() & F.col("parameter").isNotNull())
    in_range = F.col("timestamp") >= instant(analysis)
    placed = placed_rows(base)
    totals = placed.groupBy(*SERIES_KEY).agg(F.count(F.when(in_range, 1)).alias("total_readings_analysed"))
    return totals, framed(placed, block_frames=block_frames).where(in_range)


def anomalies(readings: DataFrame, cities: DataFrame, *, as_of: datetime | str | None = None, days: int = 30,
              sensitivity: float = 2.0, city_ids: Sequence[str] | None = None,
              parameters: Sequence[str] | None = None, include_suspect: bool = False,
              until: datetime | None = None, block_frames: int = BLOCK_FRAMES, sort: bool = False) -> DataFrame:
    """Readings of active cities that lie ``sensitivity`` deviations or more off their rolling baseline.

    The baseline reaches seven days further back than the reported range. That bound is stated here
    because a filter on the order column of a window is not pushed below it. ``sort`` puts the most extreme
    first within each series, at the price of a second evaluation from which the sort takes its samples.
    """
    check_days(days, lowest=7)
    check_sensitivity(sensitivity)
    totals, scored = _parts(readings, to_utc(as_of), days, city_ids, parameters, include_suspect, until, block_frames)
    found = with_scores(scored.where(deviates(sensitivity)))
    result = found.join(totals, SERIES_KEY).join(city_names(cities), "city_id").select(
        "city_id", "city_name", "parameter", canonical_unit(F.col("parameter")).alias("unit"),
        F.lit(float(sensitivity)).alias("sensitivity"), "timestamp", "value", "rolling_avg", "rolling_stddev",
        "z_score", "severity", "total_readings_analysed", "size",
    )
    if sort:
        result = result.orderBy(*SERIES_KEY, F.col("size").desc(), "timestamp")
    return result.drop("size")


def anomaly_totals(readings: DataFrame, cities: DataFrame, *, as_of: datetime | str | None = None, days: int = 30,
                   sensitivity: float = 2.0, city_ids: Sequence[str] | None = None,
                   parameters: Sequence[str] | None = None, include_suspect: bool = False,
                   until: datetime | None = None, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Per series of an active city: readings analysed and anomalies found, also where none were."""
    check_days(days, lowest=7)
    check_sensitivity(sensitivity)
    totals, scored = _parts(readings, to_utc(as_of), days, city_ids, parameters, include_suspect, until, block_frames)
    found = scored.where(deviates(sensitivity)).groupBy(*SERIES_KEY).agg(F.count(F.lit(1)).alias("anomalies"))
    return totals.join(found, SERIES_KEY, "left").join(city_names(cities), "city_id").select(
        "city_id", "city_name", "parameter", canonical_unit(F.col("parameter")).alias("unit"),
        "total_readings_analysed", F.coalesce("anomalies", F.lit(0).cast("long")).alias("anomalies"),
    )
