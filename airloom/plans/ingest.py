"""Ingest: staged readings of one cycle, their statistics and the cycle report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.operators.filters import active
from airloom.operators.upsert import flag_readings, insertable
from airloom.schemas import MISSING, SUSPECT, VALID
from airloom.sources.landed import all_sources
from airloom.sources.tables import ingest_targets, upsert_readings

_COUNTS = ["readings_fetched", "quality_valid", "quality_suspect", "quality_missing", "readings_skipped"]


def stage_readings(cities: DataFrame, *sources: DataFrame) -> DataFrame:
    """Readings of all sources for active cities, flagged."""
    flagged = flag_readings(all_sources(*sources))
    return flagged.join(ingest_targets(cities), "city_id", "left_semi")


def ingest_stats(staged: DataFrame, cities: DataFrame) -> DataFrame:
    """Readings fetched per active city and how they were flagged, zero for a city without any."""
    flag = F.col("quality_flag")
    stored = F.col("value").isNotNull() | (flag == MISSING)
    counted = staged.groupBy("city_id").agg(
        F.count(F.lit(1)).alias("readings_fetched"),
        F.count_if(flag == VALID).alias("quality_valid"),
        F.count_if(flag == SUSPECT).alias("quality_suspect"),
        F.count_if(flag == MISSING).alias("quality_missing"),
        F.count_if(~stored).alias("readings_skipped"),
    )
    names = active(cities).select(F.col("id").alias("city_id"), F.col("name").alias("city_name"))
    zero = F.lit(0).cast("long")
    return names.join(counted, "city_id", "left").select(
        "city_id", "city_name", *[F.coalesce(name, zero).alias(name) for name in _COUNTS])


def merge_counts(merged: DataFrame) -> DataFrame:
    """Rows inserted and updated per city, from the rows of a merge."""
    return merged.groupBy("city_id").agg(
        F.count_if(F.col("action") == "inserted").alias("readings_inserted"),
        F.count_if(F.col("action") == "updated").alias("readings_updated"))


def cycle_report(cities: DataFrame, counts: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per cycle: cities attempted, succeeded and failed, and readings written.

    ``counts`` comes from :func:`merge_counts`, ``errors`` holds (city_id, error). A city fails with its
    first error; one without readings but without errors succeeds.
    """
    failed = errors.select("city_id").distinct().withColumn("failed", F.lit(True))
    names = active(cities).select(F.col("id").alias("city_id"))
    rows = names.join(failed, "city_id", "left").join(counts, "city_id", "left")
    written = F.col("readings_inserted") + F.col("readings_updated")
    return rows.agg(
        F.count(F.lit(1)).alias("cities_attempted"),
        F.count_if(F.col("failed").isNull()).alias("cities_succeeded"),
        F.count_if(F.col("failed")).alias("cities_failed"),
        F.coalesce(F.sum(written), F.lit(0).cast("long")).alias("total_readings"),
    )


def run_ingest(spark: SparkSession, staged: DataFrame, path: str, as_of: datetime) -> dict[str, int]:
    """Upsert staged readings; returns the inserted and updated counts."""
    return upsert_readings(spark, insertable(staged), path, as_of)
