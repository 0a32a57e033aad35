"""Timestamps: literals, parsing and bucketing. All instants are UTC."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Interval names as given and as reported.
INTERVALS = {"hour": "hour", "day": "day", "week": "week", "hourly": "hour", "daily": "day", "weekly": "week"}
INTERVAL_LABELS = {"hour": "hourly", "day": "daily", "week": "weekly"}

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
_ZONED = r"^.{11,}(Z|[+-]\d{2}:?\d{2})$"
_HOURLY = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$"


def to_utc(moment: datetime | str | None) -> datetime:
    """A Python instant in UTC; naive input counts as UTC and None means now."""
    if moment is None:
        return datetime.now(timezone.utc)
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment.replace("Z", "+00:00"))
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def instant(moment: datetime) -> Column:
    """Timestamp literal; written as text with a zone so that no local zone can shift it."""
    return F.lit(moment.strftime("%Y-%m-%dT%H:%M:%S.%fZ")).cast("timestamp")


def day_literal(moment: datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d")).cast("date")


def days_before(moment: datetime, days: float) -> datetime:
    return moment - timedelta(days=days)


def interval_name(interval: str) -> str:
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {sorted(INTERVALS)}, not {interval!r}")
    return INTERVALS[interval]


def period_start(interval: str, moment: Column) -> Column:
    """Start of the hour, day or ISO week (Monday); the session zone must be UTC."""
    return F.date_trunc(interval_name(interval), moment)


def parse_iso(text: Column) -> Column:
    """ISO text to an instant: with Z, with an offset, naive (UTC), or without seconds; else NULL."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    timed = F.regexp_replace(trimmed, r"^(.{16})($|Z|[+-])", "$1:00$2")
    zoned = (
        F.when(timed.rlike(_ZONED), timed)
        .when(F.length(timed) > 10, F.concat(timed, F.lit("Z")))
        .otherwise(F.concat(trimmed, F.lit("T00:00:00Z")))
    )
    return F.when(trimmed.rlike(_ISO), zoned.try_cast("timestamp"))


def parse_hourly(text: Column) -> Column:
    """Strict ``YYYY-MM-DDTHH:MM`` in UTC; anything else is NULL."""
    return F.when(text.rlike(_HOURLY), F.concat(text, F.lit(":00Z")).try_cast("timestamp"))


def first_present(*texts: Column) -> Column:
    """First text that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(text, F.lit("")) for text in texts])


def period_label(start: datetime, end: datetime) -> str:
    return f"{start:%Y-%m-%d} to {end:%Y-%m-%d}"
