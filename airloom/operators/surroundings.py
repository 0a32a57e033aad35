"""Interval join: the readings around given moments, folded to one entry per timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def surroundings(moments: DataFrame, readings: DataFrame, *, moment_key: list[str], hours: int = 3,
                 last_timestamps: int = 7) -> DataFrame:
    """Readings of the same city within ``hours`` of each moment, keeping the last timestamps of the span.

    ``moments`` holds city_id, ``moment_key`` and ``timestamp``. The hour cell in the join key keeps a busy
    city from landing in one task; each reading meets only the moments whose span touches its hour. Adaptive
    execution picks the join by the size the moments turn out to have. The ranking cuts every map task's
    output to ``last_timestamps`` timestamps per moment before the shuffle.
    """
    span = F.expr(f"INTERVAL {hours} HOURS")
    hour = F.date_trunc("hour", F.col("timestamp"))
    cells = F.sequence(F.date_trunc("hour", F.col("timestamp") - span),
                       F.date_trunc("hour", F.col("timestamp") + span), F.expr("INTERVAL 1 HOUR"))
    wanted = moments.select(*dict.fromkeys(["city_id", *moment_key]), F.col("timestamp").alias("moment"),
                            F.explode(cells).alias("hour_cell"))
    near = readings.select("city_id", "timestamp", "parameter", "value", hour.alias("hour_cell"))
    keys = list(dict.fromkeys(["city_id", *moment_key, "moment"]))
    latest_first = W.partitionBy(*keys).orderBy(F.col("timestamp").desc())
    return (
        near.join(wanted, ["city_id", "hour_cell"])
        .where(F.col("timestamp").between(F.col("moment") - span, F.col("moment") + span))
        .drop("hour_cell")
        .withColumn("recency", F.dense_rank().over(latest_first))
        .where(F.col("recency") <= last_timestamps)
        .drop("recency")
    )


def wide_entries(near: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and timestamp with a parameter-to-value map.

    A timestamp holds one value per parameter, so the collected list is as long as the parameter list.
    """
    return near.groupBy(*keys, "timestamp").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("parameter", "value")))).alias("values")
    )
