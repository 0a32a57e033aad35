"""Small literal frames."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from airloom.schemas import CITIES, READINGS, STAGED_READINGS

UTC = timezone.utc
NOON = datetime(2026, 2, 20, 12, tzinfo=UTC)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


def city_frame(spark, *rows):
    """rows: (id, name, country, country_code, is_active)."""
    made = at("2026-01-01")
    return spark.createDataFrame(
        [(i, n, c, cc, 51.5, -0.1, "Europe/London", a, made, made) for i, n, c, cc, a in rows], CITIES)


def seed_cities(spark):
    return city_frame(spark, ("derby", "Derby", "United Kingdom", "GB", True),
                      ("leeds", "Leeds", "United Kingdom", "GB", True))


def reading_frame(spark, rows, created=None):
    """rows: (city_id, parameter, value, timestamp[, flag])."""
    full = []
    for city, parameter, value, moment, *rest in rows:
        flag = rest[0] if rest else ("missing" if value is None else "valid")
        stamp = created or moment
        full.append((f"{city}-{parameter}-{moment:%Y%m%d%H%M%S}", city, parameter, value, "u", value, "u", flag, "test",
                     moment, stamp, stamp, moment.date()))
    return spark.createDataFrame(full, READINGS)


def staged_frame(spark, rows):
    """rows: (city_id, parameter, value, timestamp, ingest_seq)."""
    full = [(c, p, v, "u", v, "u", t, "test", None, n) for c, p, v, t, n in rows]
    return spark.createDataFrame(full, STAGED_READINGS)


def seed_readings(spark):
    """Sixty hourly PM2.5 readings of one city in a sawtooth between 20 and 25, with one spike."""
    start = at("2026-02-18T09:00:00")
    values = [71.5 if hour == 37 else 20 + hour * 7 % 11 / 2 for hour in range(60)]
    return reading_frame(spark, [("derby", "pm25", v, start + timedelta(hours=h)) for h, v in enumerate(values)])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def each(spark, values, kind, function):
    """Results of a column function over a list of inputs, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]
