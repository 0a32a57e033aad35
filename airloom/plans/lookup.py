"""Single readings: range look-up, health and freshness."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions.numeric import minutes_between
from airloom.functions.times import instant, to_utc
from airloom.operators.filters import allowed_flags, between_instants, check_page, city_names, page, select_series
from airloom.operators.positions import deep_page
from airloom.schemas import READING_KEY
from airloom.sources.tables import reading_view

INGEST_INTERVAL_MINUTES = 60


def readings_range(readings: DataFrame, *, start: datetime | str | None = None, end: datetime | str | None = None,
                   city_ids: Sequence[str] | None = None, parameters: Sequence[str] | None = None,
                   include_suspect: bool = False) -> DataFrame:
    """Readings between two instants, both included; without a start the 24 hours before the call."""
    now = to_utc(None)
    until = to_utc(end) if end is not None else now
    since = to_utc(start) if start is not None else now - timedelta(hours=24)
    if since >= until:
        raise ValueError("start must be before end")
    kept = between_instants(readings, since, until, closed=True)
    kept = select_series(kept, city_ids, parameters)
    return reading_view(kept.where(F.col("quality_flag").isin(list(allowed_flags(include_suspect)))))


PAGE_ORDER = ["timestamp", *[name for name in READING_KEY if name != "timestamp"]]


def readings_page(rows: DataFrame, skip: int = 0, limit: int = 100, after: Sequence | None = None) -> DataFrame:
    """One page of a range look-up in time order; ``after`` (timestamp, city, parameter) goes on from a page before."""
    return page(rows, PAGE_ORDER, skip, limit, after)


def readings_deep_page(rows: DataFrame, skip: int, limit: int = 100) -> DataFrame:
    """The same far from the start, without passing all rows before it through one task."""
    check_page(skip, limit)
    return deep_page(rows, PAGE_ORDER, skip, limit)


def _freshness(rows: DataFrame, now: datetime, interval_minutes: int) -> DataFrame:
    age = minutes_between(F.col("last_ingestion_at"), instant(now))
    stale = F.unix_micros(instant(now)) - F.unix_micros("last_ingestion_at") > interval_minutes * 2 * 60 * 1_000_000
    return rows.withColumns({
        "staleness_minutes": age,
        "status": F.when(stale, "degraded").otherwise("healthy"),
    })


def arrivals(rows: DataFrame) -> DataFrame:
    """``city_id, created_at, timestamp`` of readings, or of a reading log, which holds the last of each per commit."""
    logged = "last_created_at" in rows.columns
    return rows.select("city_id", F.col("last_created_at" if logged else "created_at").alias("created_at"),
                       F.col("last_timestamp" if logged else "timestamp").alias("timestamp"))


def health(readings: DataFrame, *, as_of: datetime | str | None = None,
           interval_minutes: int = INGEST_INTERVAL_MINUTES) -> DataFrame:
    """One row: last ingestion, its age, and degraded once that exceeds two intervals.

    ``readings`` may be the table's log (``reading_log``) as well: the answer is the same and no reading is read.
    """
    latest = arrivals(readings).agg(F.max("created_at").alias("last_ingestion_at"))
    return _freshness(latest, to_utc(as_of), interval_minutes)


def freshness(readings: DataFrame, cities: DataFrame, *, as_of: datetime | str | None = None,
              interval_minutes: int = INGEST_INTERVAL_MINUTES) -> DataFrame:
    """The same per active city, with the newest measurement; a city that never reported is degraded."""
    latest = arrivals(readings).groupBy("city_id").agg(
        F.max("created_at").alias("last_ingestion_at"), F.max("timestamp").alias("data_freshness"))
    joined = city_names(cities).join(latest, "city_id", "left")
    rated = _freshness(joined, to_utc(as_of), interval_minutes)
    return rated.withColumn(
        "status", F.when(F.col("last_ingestion_at").isNull(), "degraded").otherwise(F.col("status")))
