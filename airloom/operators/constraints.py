"""Table rules, checked as a set: which rows break which rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.schemas import MISSING, QUALITY_FLAGS, READING_KEY


def constraint_violations(readings: DataFrame, cities: DataFrame) -> DataFrame:
    """One row per broken rule and key: duplicates, unknown flags, orphans, values that contradict the flag.

    The three rules about single rows share one scan; the duplicate check reads only the key columns.
    """
    known = cities.select(F.col("id").alias("city_id"), F.lit(True).alias("known"))
    flag = F.col("quality_flag")
    broken = F.array_compact(F.array(
        F.when(flag.isNull() | ~flag.isin(*QUALITY_FLAGS), "quality_flag_domain"),
        F.when(F.col("known").isNull(), "city_reference"),
        F.when(F.col("value").isNull() != (flag == MISSING), "missing_means_null"),
    ))
    single = readings.join(known, "city_id", "left").select(
        F.explode(broken).alias("rule"), *READING_KEY, F.lit(1).cast("long").alias("violating_rows"))
    duplicates = readings.groupBy(*READING_KEY).agg(F.count(F.lit(1)).alias("violating_rows")).where(
        "violating_rows > 1")
    return single.unionByName(duplicates.withColumn("rule", F.lit("unique_key")))
