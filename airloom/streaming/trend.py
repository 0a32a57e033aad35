"""Trend of arriving readings: buckets merged as they change, or emitted once when they close."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.functions.numeric import round_half_up
from airloom.functions.times import interval_name
from airloom.schemas import READING_KEY, SERIES_KEY, VALID
from airloom.session import written
from airloom.sources.layers import REPLACED, Layout, append_layer, compact, read_layers
from airloom.sources.tables import READINGS_LAYOUT

LATENESS = "25 hours"
# Windows are counted from 1970-01-01, a Thursday; four days on, weeks start on Monday.
_WINDOWS = {"hour": ("1 hour", "0 seconds"), "day": ("1 day", "0 seconds"), "week": ("7 days", "4 days")}
_DAYS = {"hour": 1, "day": 1, "week": 7}
COMPACT_EVERY = 32

TREND_LAYOUT = Layout(
    T.StructType([*[T.StructField(name, T.StringType()) for name in SERIES_KEY], T.StructField("period", T.TimestampType()),
                  *[T.StructField(name, T.DoubleType()) for name in ("avg", "min", "max")],
                  T.StructField("reading_count", T.LongType()), T.StructField("period_date", T.DateType())]),
    keys=(*SERIES_KEY, "period"), partitions=("parameter", "period_date"), sort=("city_id", "period"))


def _statistics(value) -> list:
    return [round_half_up(F.avg(value), 4).alias("avg"), round_half_up(F.min(value), 4).alias("min"),
            round_half_up(F.max(value), 4).alias("max"), F.count(value).alias("reading_count")]


def trend_writer(table: str, trends: str, interval: str = "day", *,
                 compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """An ``after`` step for the ingest stream that keeps a table of bucket statistics equal to the batch trend.

    Every bucket that a batch falls into is computed again from the readings of its days and merged, so late readings of
    any age, corrections and buckets that are still open all count. A bucket whose last valid reading was corrected
    away stays with a count of 0, which :func:`read_trend` leaves out. Repeating a batch changes nothing.
    """
    name = interval_name(interval)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        period = F.date_trunc(name, "timestamp").alias("period")
        touched = written(batch.select(*SERIES_KEY, period).distinct().withColumn("period_date", F.to_date("period")), "trend-touched")
        days = touched.select("parameter", F.explode(F.sequence(
            "period_date", F.date_add("period_date", _DAYS[name] - 1))).alias("reading_date")).distinct()
        readings = read_layers(spark, table, READINGS_LAYOUT, touched=days).where(F.col("quality_flag") == VALID)
        values = readings.select(*SERIES_KEY, period, "value").join(touched, [*SERIES_KEY, "period"], "left_semi")
        # Partial sums leave the tasks that read; a bucket without readings comes from ``touched``.
        counted = values.groupBy(*SERIES_KEY, "period").agg(*_statistics(F.col("value")))
        stored = read_layers(spark, trends, TREND_LAYOUT, touched=touched).select(
            *SERIES_KEY, "period", F.lit(True).alias(REPLACED))
        made = touched.join(counted, [*SERIES_KEY, "period"], "left").join(stored, [*SERIES_KEY, "period"], "left")
        fresh = written(made.fillna({"reading_count": 0, REPLACED: False}), "trend-fresh")
        append_layer(spark, trends, TREND_LAYOUT, fresh)
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact(spark, trends, TREND_LAYOUT)

    return write


def read_trend(spark: SparkSession, trends: str) -> DataFrame:
    """The buckets that hold valid readings now."""
    return read_layers(spark, trends, TREND_LAYOUT).where("reading_count > 0").drop("period_date")


def stream_trend(readings: DataFrame, interval: str = "day", *, lateness: str = LATENESS,
                 deduplicate: bool = True) -> DataFrame:
    """Bucket statistics of arriving valid readings, emitted once a bucket can no longer change (append mode).

    For consumers that can take no corrections. Repeated deliveries of a key within the lateness count once and the first
    value stands. Readings later than that are dropped here; :func:`trend_writer` takes all of them in.
    """
    width, start = _WINDOWS[interval_name(interval)]
    valid = readings.where(F.col("quality_flag") == VALID).withWatermark("timestamp", lateness)
    if deduplicate:
        valid = valid.dropDuplicatesWithinWatermark(READING_KEY)
    value = F.col("value")
    return (
        valid.groupBy(*SERIES_KEY, F.window("timestamp", width, width, start).alias("bucket"))
        .agg(round_half_up(F.avg(value), 4).alias("avg"), round_half_up(F.min(value), 4).alias("min"),
             round_half_up(F.max(value), 4).alias("max"), F.count(F.lit(1)).alias("reading_count"))
        .select(*SERIES_KEY, F.col("bucket.start").alias("period"), "avg", "min", "max", "reading_count")
    )
