"""Declared schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

VALID, SUSPECT, MISSING = "valid", "suspect", "missing"
QUALITY_FLAGS = (VALID, SUSPECT, MISSING)

# The unit each parameter is stored in.
CANONICAL_UNITS = {
    "pm25": "µg/m³",
    "pm10": "µg/m³",
    "no2": "µg/m³",
    "o3": "µg/m³",
    "co": "µg/m³",
    "so2": "µg/m³",
    "temperature": "°C",
    "humidity": "%",
    "wind_speed": "m/s",
    "precipitation": "mm",
}

# Inclusive plausible range per parameter; outside it a reading is suspect.
PLAUSIBLE_BOUNDS = {
    "pm25": (0.0, 500.0),
    "pm10": (0.0, 600.0),
    "no2": (0.0, 400.0),
    "o3": (0.0, 300.0),
    "co": (0.0, 50000.0),
    "so2": (0.0, 500.0),
    "temperature": (-30.0, 50.0),
    "humidity": (0.0, 100.0),
    "wind_speed": (0.0, 100.0),
    "precipitation": (0.0, 500.0),
}

# Source field names and the parameters they feed.
POLLUTANTS = ("pm25", "pm10", "no2", "o3", "co", "so2")
WEATHER_FIELDS = {
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
    "wind_speed_10m": "wind_speed",
    "precipitation": "precipitation",
}
SUMMARY_PARAMETERS = ("pm25", "pm10", "no2", "o3", "temperature", "humidity", "wind_speed")
ANOMALY_PARAMETERS = ("pm25", "pm10", "no2", "o3")
CONTEXT_PAIRS = (("pm25", "temperature"), ("pm25", "humidity"))

# Place of a reading inside the document it arrived in; optional in staged readings.
ARRIVAL_PLACE = "ingest_pos"
READING_KEY = ["city_id", "parameter", "timestamp"]
SERIES_KEY = ["city_id", "parameter"]
READING_PARTITIONS = ["parameter", "reading_date"]

_string, _double, _time = T.StringType(), T.DoubleType(), T.TimestampType()


def _fields(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


READINGS = _fields(
    ("id", _string, True), ("city_id", _string, False), ("parameter", _string, False),
    ("value", _double, True), ("unit", _string, False), ("raw_value", _double, True),
    ("raw_unit", _string, True), ("quality_flag", _string, False), ("source", _string, False),
    ("timestamp", _time, False), ("created_at", _time, False), ("updated_at", _time, False),
    ("reading_date", T.DateType(), False),
)

STAGED_READINGS = _fields(
    ("city_id", _string, False), ("parameter", _string, False), ("value", _double, True),
    ("unit", _string, True), ("raw_value", _double, True), ("raw_unit", _string, True),
    ("timestamp", _time, False), ("source", _string, False), ("quality_flag", _string, True),
    ("ingest_seq", T.LongType(), False),
)

CITIES = _fields(
    ("id", _string, False), ("name", _string, False), ("country", _string, False),
    ("country_code", _string, False), ("latitude", _double, False), ("longitude", _double, False),
    ("timezone", _string, False), ("is_active", T.BooleanType(), False),
    ("created_at", _time, True), ("updated_at", _time, True),
)

INSIGHT_CACHE = _fields(
    ("id", _string, False), ("city_id", _string, False), ("generated_at", _time, False),
    ("expires_at", _time, False), ("insight_text", _string, False), ("context_hash", _string, False),
    ("model_used", _string, False), ("input_tokens", T.IntegerType(), True),
    ("output_tokens", T.IntegerType(), True), ("created_at", _time, True), ("updated_at", _time, True),
    ("generated_date", T.DateType(), False),
)

# Landed documents: one JSON document per line. ``city_id`` and ``fetched_at`` are added by whatever lands
# them; ``error`` is filled instead of ``results`` when a fetch failed.
_utc = T.StructType([T.StructField("utc", _string)])
_sensor = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("parameter", T.StructType([T.StructField("name", _string), T.StructField("units", _string)])),
])
LOCATIONS_DOC = T.StructType([
    T.StructField("city_id", _string), T.StructField("fetched_at", _string), T.StructField("error", _string),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("name", _string), T.StructField("sensors", T.ArrayType(_sensor))]))),
])
MEASUREMENTS_DOC = T.StructType([
    T.StructField("city_id", _string), T.StructField("sensor_id", T.LongType()),
    T.StructField("fetched_at", _string), T.StructField("error", _string),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("value", _double), T.StructField("datetime", _utc),
        T.StructField("period", T.StructType([T.StructField("datetimeFrom", _utc)]))]))),
])
WEATHER_DOC = T.StructType([
    T.StructField("city_id", _string), T.StructField("fetched_at", _string), T.StructField("error", _string),
    T.StructField("hourly", T.StructType(
        [T.StructField("time", T.ArrayType(_string))]
        + [T.StructField(name, T.ArrayType(_double)) for name in WEATHER_FIELDS])),
    T.StructField("hourly_units", T.StructType([T.StructField(name, _string) for name in WEATHER_FIELDS])),
])
CORRUPT_COLUMN = "_corrupt_record"
