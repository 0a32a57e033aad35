"""Time-bucketed trend."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airloom.functions.numeric import round_half_up
from airloom.functions.quality import canonical_unit
from airloom.functions.times import INTERVAL_LABELS, days_before, interval_name, period_start, to_utc
from airloom.operators.filters import city_names, usable_readings
from airloom.schemas import SERIES_KEY


def check_days(days: int, lowest: int = 1, highest: int = 365) -> None:
    if not lowest <= days <= highest:
        raise ValueError(f"days must be between {lowest} and {highest}")


def bucket_statistics(base: DataFrame, interval: str) -> DataFrame:
    """avg, min, max and count per series and bucket, rounded to four places."""
    value = F.col("value")
    return base.groupBy(*SERIES_KEY, period_start(interval, F.col("timestamp")).alias("period")).agg(
        round_half_up(F.avg(value), 4).alias("avg"),
        round_half_up(F.min(value), 4).alias("min"),
        round_half_up(F.max(value), 4).alias("max"),
        F.count(F.lit(1)).alias("reading_count"),
    )


def trend(readings: DataFrame, cities: DataFrame, *, as_of: datetime | str | None = None, days: int = 30,
          interval: str = "day", city_ids: Sequence[str] | None = None, parameters: Sequence[str] | None = None,
          include_suspect: bool = False, until: datetime | None = None, keep_empty: bool = False,
          sort: bool = True) -> DataFrame:
    """Bucketed statistics of every series of an active city.

    ``total_readings`` adds up the bucket counts of a series; its window runs over buckets, of which a
    series has at most 365 x 24. With ``keep_empty``, which needs ``parameters``, a series without readings
    yields one row with a NULL period and counts of 0.
    """
    check_days(days)
    now = to_utc(as_of)
    base = usable_readings(readings, since=days_before(now, days), until=until, city_ids=city_ids,
                           parameters=parameters, include_suspect=include_suspect)
    buckets = bucket_statistics(base, interval).withColumn(
        "total_readings", F.sum("reading_count").over(W.partitionBy(*SERIES_KEY)))
    names = city_names(cities)
    if keep_empty:
        if parameters is None:
            raise ValueError("keep_empty needs the parameters to report on")
        if city_ids is not None:
            names = names.where(F.col("city_id").isin(list(city_ids)))
        wanted = names.withColumn("parameter", F.explode(F.array(*[F.lit(p) for p in parameters])))
        zero = F.lit(0).cast("long")
        joined = wanted.join(buckets, SERIES_KEY, "left").withColumns({
            name: F.coalesce(name, zero) for name in ("reading_count", "total_readings")})
    else:
        joined = buckets.join(names, "city_id")
    result = joined.select(
        "city_id", "city_name", "parameter", canonical_unit(F.col("parameter")).alias("unit"),
        F.lit(INTERVAL_LABELS[interval_name(interval)]).alias("interval"), F.lit(days).alias("days"), "period", "avg", "min",
        "max", "reading_count", "total_readings",
    )
    return result.orderBy(*SERIES_KEY, "period") if sort else result
