"""Idempotent upsert of readings: match on the key, write only real changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airloom.functions.quality import normalise_weather, quality_flag, canonical_unit
from airloom.functions.times import instant
from airloom.operators.filters import changed
from airloom.schemas import ARRIVAL_PLACE, MISSING, QUALITY_FLAGS, READING_KEY, VALID

_CARRIED = ["value", "unit", "raw_value", "raw_unit", "quality_flag", "source"]


def reading_id(city_id: Column, parameter: Column, timestamp: Column) -> Column:
    """Id that follows from the key, so a replay creates the same one."""
    return F.sha2(F.concat_ws("#", city_id, parameter, F.unix_micros(timestamp).cast("string")), 256)


def latest_per_key(batch: DataFrame, keys: list[str] = READING_KEY, order: str = "ingest_seq") -> DataFrame:
    """The last arrival of every key. Copies of one key are cut on the map side, before the shuffle.

    Arrivals are ordered by fetch time, source and place inside the document, then by what they say, so that
    the result does not depend on how rows lie in partitions.
    """
    # The last column of the key leads: timestamps are told apart as numbers, cities only letter by letter.
    newest_first = W.partitionBy(*reversed(keys)).orderBy(*[F.col(c).desc() for c in [order, *_told(batch, keys, order)]])
    return batch.withColumn("_arrival", F.row_number().over(newest_first)).where("_arrival = 1").drop("_arrival")


def _told(batch: DataFrame, keys: list[str], order: str) -> list[str]:
    """What orders arrivals of one key that came at the same time."""
    return [c for c in ("source", ARRIVAL_PLACE, "value", "raw_value", "unit", "raw_unit", "quality_flag")
            if c in batch.columns and c not in keys and c != order]


def counted_latest(flagged: DataFrame) -> DataFrame:
    """Keys, measured columns and order of the rows that :func:`latest_per_key` keeps, with counts of all arrivals per flag.

    ``arrived_valid``, ``arrived_suspect`` and ``arrived_missing`` add up to the rows of ``flagged``, which is passed over once.
    """
    order = ["ingest_seq", *_told(flagged, READING_KEY, "ingest_seq")]
    return flagged.groupBy(*reversed(READING_KEY)).agg(
        F.max(F.struct(*order)).alias("_last"),
        *[F.count_if(F.col("quality_flag") == flag).alias(f"arrived_{flag}") for flag in QUALITY_FLAGS],
    ).select(*READING_KEY, "_last.*", *[f"arrived_{flag}" for flag in QUALITY_FLAGS])


def merge_readings(target: DataFrame, batch: DataFrame, as_of: datetime, *, kept: bool = True,
                   latest: bool = False) -> DataFrame:
    """Target rows and batch rows merged on the key, with an ``action`` per row.

    inserted: new key. updated: value or flag differs, NULL included, and everything measured is replaced.
    unchanged: same value and flag, so the stored row stays as it is even if unit or source differ.
    kept: not in the batch; without ``kept`` these are left out. ``created_at`` survives; ``updated_at`` moves only
    with a change. ``valid_change`` tells by how much the number of valid readings moves. ``latest`` says that the batch
    has one row per key already.
    """
    incoming = (batch if latest else latest_per_key(batch)).select(
        *READING_KEY, *[F.col(name).alias(f"new_{name}") for name in _CARRIED], F.lit(True).alias("arrived"))
    stored = target.withColumn("stored", F.lit(True))
    joined = stored.join(incoming, READING_KEY, "full_outer" if kept else "right")

    action = (
        F.when(F.col("stored").isNull(), "inserted")
        .when(F.col("arrived").isNull(), "kept")
        .when(changed(F.col("new_value"), F.col("value"))
              | changed(F.col("new_quality_flag"), F.col("quality_flag")), "updated")
        .otherwise("unchanged")
    )
    taken = F.col("action").isin("inserted", "updated")
    now = instant(as_of)

    def valid(flag: str) -> Column:
        return F.coalesce((F.col(flag) == VALID).cast("int"), F.lit(0))

    return joined.withColumn("action", action).select(
        F.coalesce("id", reading_id(F.col("city_id"), F.col("parameter"), F.col("timestamp"))).alias("id"),
        "city_id", "parameter",
        *[F.when(taken, F.col(f"new_{name}")).otherwise(F.col(name)).alias(name) for name in _CARRIED],
        "timestamp",
        F.coalesce("created_at", now).alias("created_at"),
        F.when(taken, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.to_date("timestamp").alias("reading_date"),
        "action", F.when(taken, valid("new_quality_flag") - valid("quality_flag")).otherwise(0).alias("valid_change"),
    )


def flag_readings(staged: DataFrame) -> DataFrame:
    """Set the quality flag of every staged reading."""
    return staged.withColumn("quality_flag", quality_flag(F.col("parameter"), F.col("value")))


def insertable(staged: DataFrame) -> DataFrame:
    """Readings worth storing: a value, or an explicit gap. Flagged rows always satisfy it."""
    return staged.where(F.col("value").isNotNull() | (F.col("quality_flag") == MISSING))


def reprocess(readings: DataFrame) -> DataFrame:
    """Value, unit and flag computed again from the raw columns, as a batch for the upsert.

    Conversion applies where the raw unit asks for it; the row's old position in the table does not matter.
    """
    value = normalise_weather(F.col("parameter"), F.col("raw_value"), F.col("raw_unit"))
    return flag_readings(
        readings.withColumn("value", value).withColumn("unit", canonical_unit(F.col("parameter"), F.col("raw_unit")))
    )
