"""Landed API payloads to staged readings.

Each landed file holds one JSON document per line with the city it was fetched for. The same parsers serve
batch and streaming frames.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.functions.quality import canonical_unit, normalise_weather
from airloom.functions.times import first_present, instant, parse_hourly, parse_iso
from airloom.schemas import (
    ARRIVAL_PLACE, CORRUPT_COLUMN, LOCATIONS_DOC, MEASUREMENTS_DOC, POLLUTANTS, STAGED_READINGS, WEATHER_DOC, WEATHER_FIELDS,
)

# How the two providers are named in the source column.
AIR_SOURCE, WEATHER_SOURCE = "openaq", "open-meteo"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT_COLUMN, T.StringType())])


def read_documents(spark: SparkSession, path: str, schema: T.StructType, *, streaming: bool = False) -> DataFrame:
    """JSON lines under a declared schema; an unreadable line keeps its text in the corrupt-record column."""
    reader = spark.readStream if streaming else spark.read
    return (
        reader.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN).json(path)
    )


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, LOCATIONS_DOC)


def read_measurements(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    return read_documents(spark, path, MEASUREMENTS_DOC, streaming=streaming)


def read_weather(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    return read_documents(spark, path, WEATHER_DOC, streaming=streaming)


def chosen_sensors(locations: DataFrame) -> DataFrame:
    """One sensor per city and known pollutant: the first in station order, then in sensor order.

    ``locations`` are documents whose stations are listed nearest first. Where a city has several documents
    the newest one counts; of equally new ones the same one in every run.
    """
    newest = W.partitionBy("city_id").orderBy(parse_iso(F.col("fetched_at")).desc_nulls_last(),
                                              F.xxhash64("results").desc())
    listed = W.partitionBy("city_id", "parameter").orderBy("station_pos", "sensor_pos")
    stations = (
        locations.where(F.col("results").isNotNull())
        .withColumn("age", F.row_number().over(newest)).where("age = 1")
        .select("city_id", F.posexplode("results").alias("station_pos", "station"))
    )
    sensors = stations.select("city_id", "station_pos", F.col("station.name").alias("station_name"),
                              F.posexplode("station.sensors").alias("sensor_pos", "sensor"))
    return (
        sensors.select(
            "city_id", F.lower("sensor.parameter.name").alias("parameter"),
            F.col("sensor.id").alias("sensor_id"),
            F.coalesce("sensor.parameter.units", F.lit("µg/m³")).alias("sensor_unit"),
            F.coalesce("station_name", F.lit("unknown")).alias("station_name"), "station_pos", "sensor_pos")
        .where(F.col("parameter").isin(*POLLUTANTS))
        .withColumn("choice", F.row_number().over(listed)).where("choice = 1")
        .select("city_id", "parameter", "sensor_id", "sensor_unit", "station_name")
    )


def parse_measurements(documents: DataFrame, sensors: DataFrame, as_of: datetime | None = None, *,
                       keep_hours: int = 24) -> DataFrame:
    """Measurement documents of the chosen sensors to staged readings.

    The value is stored as measured although the unit column names the storage unit. Rows without a readable
    timestamp are dropped. ``sensors`` comes from :func:`chosen_sensors`. With ``as_of``, only the last
    ``keep_hours`` are taken, which is what the provider is asked for.
    """
    results = documents.select("city_id", "sensor_id", "fetched_at", F.posexplode("results").alias("pos", "result"))
    moment = parse_iso(first_present(F.col("result.datetime.utc"), F.col("result.period.datetimeFrom.utc")))
    rows = results.select("city_id", "sensor_id", "fetched_at", "pos", F.col("result.value").alias("value"),
                          moment.alias("timestamp")).where(F.col("timestamp").isNotNull())
    if as_of is not None:
        rows = rows.where(F.col("timestamp").between(instant(as_of - timedelta(hours=keep_hours)), instant(as_of)))
    return rows.join(sensors, ["city_id", "sensor_id"]).select(
        "city_id", "parameter", "value",
        canonical_unit(F.col("parameter"), F.col("sensor_unit")).alias("unit"),
        F.col("value").alias("raw_value"), F.col("sensor_unit").alias("raw_unit"), "timestamp",
        F.lit(AIR_SOURCE).alias("source"), F.lit(None).cast("string").alias("quality_flag"),
        arrival_number(F.col("fetched_at")).alias("ingest_seq"), F.col("pos").cast("long").alias("ingest_pos"),
    )


def parse_weather(documents: DataFrame, as_of: datetime | None = None, *, keep_hours: int = 25) -> DataFrame:
    """Weather documents with parallel arrays to staged readings.

    A value array shorter than the time array ends early: the hours beyond it do not become missing
    readings. A NULL inside the array does. With ``as_of``, hours older than ``keep_hours`` are left out.
    """
    # Once per document, not once per reading.
    numbered = documents.withColumn("ingest_seq", arrival_number(F.col("fetched_at")))
    hours = numbered.select(
        "city_id", "ingest_seq", "hourly", "hourly_units", F.posexplode("hourly.time").alias("pos", "hour"))
    moment = parse_hourly(F.col("hour"))
    hours = hours.withColumn("timestamp", moment).where(F.col("timestamp").isNotNull())
    if as_of is not None:
        hours = hours.where(F.col("timestamp") >= instant(as_of - timedelta(hours=keep_hours)))
    held = hours.select("city_id", "ingest_seq", "pos", "timestamp", "hourly", *[
        column for field in WEATHER_FIELDS for column in (
            F.get(F.col(f"hourly.{field}"), F.col("pos")).alias(f"value_{field}"),
            F.coalesce(F.col(f"hourly_units.{field}"), F.lit("unknown")).alias(f"unit_{field}"))])

    def entry(field: str, parameter: str) -> Column:
        raw_value, raw_unit = F.col(f"value_{field}"), F.col(f"unit_{field}")
        return F.struct(
            F.lit(parameter).alias("parameter"),
            (F.col("pos") < F.coalesce(F.size(F.col(f"hourly.{field}")), F.lit(0))).alias("present"),
            normalise_weather(F.lit(parameter), raw_value, raw_unit).alias("value"),
            canonical_unit(F.lit(parameter), raw_unit).alias("unit"),
            raw_value.alias("raw_value"), raw_unit.alias("raw_unit"))

    # Values and units are worked out inside the entries, from plain columns and where the parameter is a constant. After the
    # explosion the rounding of wind speeds would be copied into every use of the value, into code too long to be compiled.
    entries = F.array(*[entry(field, parameter) for field, parameter in WEATHER_FIELDS.items()])
    rows = held.select("city_id", "ingest_seq", "pos", "timestamp", F.explode(entries).alias("entry")).where("entry.present")
    return rows.select(
        "city_id", *[F.col(f"entry.{name}").alias(name) for name in ("parameter", "value", "unit", "raw_value", "raw_unit")],
        "timestamp", F.lit(WEATHER_SOURCE).alias("source"), F.lit(None).cast("string").alias("quality_flag"),
        "ingest_seq", F.col("pos").cast("long").alias("ingest_pos"),
    )


def arrival_number(fetched_at):
    """Arrival order of a document: its fetch time in microseconds."""
    return F.coalesce(F.unix_micros(parse_iso(fetched_at)), F.lit(0)).cast("long")


def all_sources(*staged: DataFrame) -> DataFrame:
    """Bag union of the sources' staged readings, with their places inside a document where all have them."""
    columns = STAGED_READINGS.fieldNames()
    if all(ARRIVAL_PLACE in s.columns for s in staged):
        columns = [*columns, ARRIVAL_PLACE]
    union = staged[0].select(*columns)
    for other in staged[1:]:
        union = union.unionByName(other.select(*columns))
    return union


def fetch_errors(*documents: DataFrame) -> DataFrame:
    """(city_id, error) of the documents that report a failed fetch."""
    errors = [d.where(F.col("error").isNotNull() & F.col("city_id").isNotNull()).select("city_id", "error")
              for d in documents]
    union = errors[0]
    for other in errors[1:]:
        union = union.unionByName(other)
    return union
