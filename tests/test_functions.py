import random

import pytest
from hypothesis import given as generated
from hypothesis import settings, strategies as st
from pyspark.sql import functions as F

from airloom.functions import labels, numeric, quality, text, times
from airloom.operators.upsert import flag_readings
from airloom.schemas import PLAUSIBLE_BOUNDS
from helpers import NOON, at, each, one, staged_frame

def flag_cases():
    """Both bounds of every parameter, just beyond and between them, and what has no bounds."""
    cases = [("pm25", float("nan"), "suspect"), ("ozone_depth", 1e9, "valid"), ("ozone_depth", -1e9, "valid"), ("ozone_depth", None, "missing")]
    for parameter, (low, high) in PLAUSIBLE_BOUNDS.items():
        cases += [(parameter, float(v), flag) for v, flag in (
            (low, "valid"), (high, "valid"), ((low + high) / 2, "valid"), (low - 0.25, "suspect"), (high + 0.25, "suspect"))]
        cases.append((parameter, None, "missing"))
    return cases


FLAG_CASES = flag_cases()


def test_quality_flags(spark):
    df = staged_frame(spark, [("c", p, v, NOON, i) for i, (p, v, _) in enumerate(FLAG_CASES)])
    got = [r["quality_flag"] for r in flag_readings(df).orderBy("ingest_seq").collect()]
    assert got == [flag for _, _, flag in FLAG_CASES]


def test_quality_batch_distribution(spark):
    df = flag_readings(staged_frame(
        spark, [("c", "pm25", v, NOON, i) for i, v in enumerate([3.0, 480.0, None, -0.5, None, 7.0, 8.0])]))
    assert dict(df.groupBy("quality_flag").count().collect()) == {"valid": 4, "suspect": 1, "missing": 2}
    assert flag_readings(df.where("1 = 0")).count() == 0


def test_iso_timestamps(spark):
    good = ["2026-02-27T10:00:00Z", "2026-02-27T10:00:00+00:00", "2026-02-27T10:00:00", "2026-02-27T10:00",
            "  2026-02-27T10:00:00Z  ", "2026-02-27T12:00:00+02:00", "2026-02-27T10:00Z", "2026-02-27T08:30-01:30"]
    bad = ["not-a-date", "", "2026", "2026-13-01T00:00:00Z", "2026-02-27T25:00:00", "2026-02-27 UTC", None]
    micros = lambda c: F.unix_micros(times.parse_iso(c))
    expected = int(at("2026-02-27T10:00:00").timestamp() * 1_000_000)
    assert each(spark, good, "string", micros) == [expected] * len(good)
    assert each(spark, bad, "string", micros) == [None] * len(bad)


def test_iso_timestamps_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = each(spark, ["2026-02-27T10:00:00", "2026-02-27"], "string", lambda c: F.unix_micros(times.parse_iso(c)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [int(at(t).timestamp() * 1_000_000) for t in ("2026-02-27T10:00:00", "2026-02-27T00:00:00")]


def test_hourly_timestamps_are_strict(spark):
    got = each(spark, ["2026-02-27T10:00", "2026-02-27T10:00:00", "2026-02-27T10:00Z", "x"], "string",
               lambda c: times.parse_hourly(c).isNotNull())
    assert got == [True, False, False, False]


def test_fallback_skips_empty_text(spark):
    assert one(spark, times.first_present(F.lit(""), F.lit(None).cast("string"), F.lit("b"))) == "b"


def test_weeks_start_on_monday(spark):
    stamp = F.lit("2026-02-22T13:00:00Z").cast("timestamp")
    assert one(spark, F.date_format(times.period_start("weekly", stamp), "yyyy-MM-dd")) == "2026-02-16"
    with pytest.raises(ValueError):
        times.interval_name("month")


def test_exact_rounding_equals_python(spark):
    rng = random.Random(7)
    values = [v / 3.6 for v in (0.09, 0.27, 0.45, 18.0, -0.09, 0.0)] + [0.125, 0.375, 2.675, 1.005, -2.675, 12.25]
    values += [rng.uniform(-500, 500) for _ in range(500)] + [rng.randrange(-10**6, 10**6) / 1000 for _ in range(500)]
    for places in (1, 2):
        assert each(spark, values, "double", lambda c: numeric.round_exact(c, places)) == [
            round(v, places) for v in values]


@settings(max_examples=5, deadline=None)
@generated(st.lists(st.floats(min_value=-1e6, max_value=1e6), min_size=50, max_size=200))
def test_exact_rounding_equals_python_anywhere(spark, values):
    assert each(spark, values, "double", lambda c: numeric.round_exact(c, 2)) == [round(v, 2) for v in values]


def test_half_up_rounding(spark):
    values = [2.675, -2.675, 12.341249999999999, 1.00005, float("nan"), float("inf"), None]
    assert each(spark, values, "double", lambda c: numeric.round_half_up(c, 2)) == [
        2.68, -2.68, 12.34, 1.0, None, None, None]
    assert each(spark, values[2:4], "double", lambda c: numeric.round_half_up(c, 4)) == [12.3413, 1.0001]


def test_percent_change_needs_a_positive_base(spark):
    df = spark.createDataFrame([(11.0, 10.0), (5.0, 0.0), (5.0, -1.0), (5.0, None)], "a double, b double")
    assert [r[0] for r in df.select(numeric.percent_change(F.col("a"), F.col("b"))).collect()] == [10.0, None, None, None]


def test_wind_is_converted_and_nothing_else(spark):
    df = spark.createDataFrame([("wind_speed", 18.0, "km/h"), ("wind_speed", 18.0, "m/s"), ("temperature", 18.0, "km/h"),
                                ("wind_speed", None, "km/h")], "p string, v double, u string")
    got = [r[0] for r in df.select(quality.normalise_weather(F.col("p"), F.col("v"), F.col("u"))).collect()]
    assert got == [5.0, 18.0, 18.0, None]


def test_units(spark):
    assert each(spark, ["pm25", "temperature", "x"], "string", quality.canonical_unit) == ["µg/m³", "°C", "unknown"]
    assert one(spark, quality.canonical_unit(F.lit("x"), F.lit("ppm"))) == "ppm"


def test_slugs(spark):
    names = ["Derby", "New York", "São Paulo", "a_b", "東京", "  St. John's  ", "A -- B", "Hong\tKong"]
    assert each(spark, names, "string", text.slug) == [
        "derby", "new-york", "so-paulo", "ab", "", "st-johns", "a-b", "hong-kong"]
    assert each(spark, ["St. John's", "New York!"], "string", text.lookup_slug) == ["st-john-s", "new-york"]


def test_labels(spark):
    assert each(spark, [3.5, -3.6, 2.5, 2.4999, 1.0], "double", labels.severity) == [
        "high", "high", "medium", "low", "low"]
    r = [None, 0.05, 0.1, -0.3, 0.7, -0.95]
    assert each(spark, r, "double", labels.correlation_strength) == [
        "negligible", "negligible", "weak", "moderate", "strong", "very_strong"]
    assert each(spark, r, "double", labels.correlation_direction) == [
        None, None, "positive", "negative", "positive", "negative"]
    assert each(spark, [5.0, 5.01, -5.01, None], "double", lambda c: labels.movement(c, absent="none")) == [
        "stable", "rising", "falling", "none"]
    assert each(spark, [12.0, 35.4, 55.4, 150.4, 151.0, None], "double", labels.pm25_category) == [
        "good", "moderate", "unhealthy_sensitive", "unhealthy", "very_unhealthy", None]


def test_pearson_is_null_without_variance(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 5.0), (2, 1.0, 2.0), (3, 1.0, 2.0), (3, 2.0, 4.0), (3, None, 9.0)],
                               "k int, a double, b double")
    got = dict(df.groupBy("k").agg(numeric.round_half_up(numeric.pearson(F.col("a"), F.col("b")), 6)).collect())
    assert got == {1: None, 2: None, 3: 1.0}
