from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from airloom.plans import insight
from airloom.sources import insights
from airloom.schemas import INSIGHT_CACHE
from helpers import at, reading_frame, seed_cities

AS_OF = at("2026-02-21T03:00:00")


@pytest.fixture(scope="module")
def readings(spark):
    start = at("2026-02-07T03:00:00")
    rows = []
    for i in range(24 * 14):
        moment = start + timedelta(hours=i)
        pm25 = 10.0 + (i % 5) + (6.0 if i >= 24 * 7 else 0.0)
        rows.append(("derby", "pm25", 80.0 if i == 24 * 12 else pm25, moment))
        rows.append(("derby", "temperature", 20.0 - (i % 5), moment))
        rows.append(("derby", "humidity", 40.0, moment))
    rows.append(("derby", "no2", 999.0, at("2026-02-20T00:30:00"), "suspect"))
    rows.append(("derby", "no2", None, at("2026-02-20T01:30:00")))
    return reading_frame(spark, rows)


@pytest.fixture(scope="module")
def context(spark, readings):
    return {r["city_id"]: r for r in insight.insight_context(readings, seed_cities(spark), AS_OF).collect()}


def test_statistics_and_quality(context):
    derby, leeds = context["derby"], context["leeds"]
    pm25 = derby["statistics"]["pm25"]
    assert pm25["trend_direction"] == "rising" and pm25["trend_pct_change"] > 10 and pm25["reading_count"] == 168
    assert derby["statistics"]["humidity"]["trend_direction"] == "stable"
    assert "no2" not in derby["statistics"]
    quality = derby["data_quality"]
    assert (quality["total_readings"], quality["suspect"], quality["missing"]) == (506, 1, 1)
    assert quality["valid_pct"] == round(504 / 506 * 100, 1)
    assert derby["period"] == "2026-02-14 to 2026-02-21"
    assert (leeds["statistics"], leeds["anomalies"], leeds["correlations"]) == ({}, [], [])
    assert leeds["data_quality"]["total_readings"] == 0


def test_anomalies_carry_their_surroundings(context):
    anomalies = context["derby"]["anomalies"]
    assert len(anomalies) == 5 and [a["position"] for a in anomalies] == [1, 2, 3, 4, 5]
    assert max(a["value"] for a in anomalies) == 80.0
    spike = next(a for a in anomalies if a["value"] == 80.0)
    assert len(spike["context_window"]) == 7
    assert [w["timestamp"] for w in spike["context_window"]] == [spike["timestamp"] + timedelta(hours=h) for h in range(-3, 4)]
    assert {v["key"] for v in spike["context_window"][0]["values"]} == {"pm25", "temperature", "humidity"}


def test_correlations_without_variance_are_left_out(context):
    assert [(c["param1"], c["param2"], c["sample_size"]) for c in context["derby"]["correlations"]] == [
        ("pm25", "temperature", 168)]


def test_flags(spark, readings):
    rows = insight.insight_context(readings, seed_cities(spark), AS_OF)
    got = {r["city_id"]: (r["concern_flag"], r["action_flag"]) for r in insight.insight_flags(rows).collect()}
    assert got == {"derby": (True, True), "leeds": (False, False)}


def test_hash_is_stable_and_sees_changes(spark, readings, context):
    again = {r["city_id"]: r["context_hash"] for r in insight.insight_context(
        readings.repartition(7, "value"), seed_cities(spark), AS_OF).collect()}
    assert again == {c: r["context_hash"] for c, r in context.items()}
    other = readings.withColumn("value", F.when(F.col("parameter") == "humidity", 41.0).otherwise(F.col("value")))
    changed = {r["city_id"]: r["context_hash"] for r in insight.insight_context(other, seed_cities(spark), AS_OF).collect()}
    assert changed["derby"] != again["derby"] and changed["leeds"] == again["leeds"]


def cache_frame(spark, *rows):
    """rows: (id, city, generated, expires, hash)."""
    return spark.createDataFrame(
        [(i, c, g, e, "text", h, "writer", 100, 10, g, g, g.date()) for i, c, g, e, h in rows], INSIGHT_CACHE)


def test_cache_decisions(spark):
    hour = timedelta(hours=1)
    cache = cache_frame(
        spark, ("1", "fresh", AS_OF - hour, AS_OF + hour, "old"), ("2", "same", AS_OF - 3 * hour, AS_OF - 2 * hour, "h"),
        ("3", "same", AS_OF - 9 * hour, AS_OF - 8 * hour, "x"), ("4", "differs", AS_OF - 3 * hour, AS_OF, "old"))
    contexts = spark.createDataFrame([(c, "h") for c in ("fresh", "same", "differs", "new")], "city_id string, context_hash string")
    got = {r["city_id"]: (r["action"], r["fallback_insight_id"], r["expires_at"] is not None)
           for r in insight.cache_decisions(contexts, cache, AS_OF).collect()}
    assert got == {"fresh": ("serve_cached", "1", True), "same": ("extend", "2", True), "differs": ("regenerate", "4", False),
                   "new": ("regenerate", None, False)}
    forced = insight.cache_decisions(contexts, cache, AS_OF, force=True)
    assert {r["action"] for r in forced.collect()} == {"regenerate"}


def test_refresh_plan_skips_served_cities(spark, readings):
    hour = timedelta(hours=1)
    cities = seed_cities(spark)
    context = {r["city_id"]: r["context_hash"] for r in insight.insight_context(readings, cities, AS_OF).collect()}
    cache = cache_frame(spark, ("1", "leeds", AS_OF - hour, AS_OF + hour, "x"),
                        ("2", "derby", AS_OF - 9 * hour, AS_OF - hour, context["derby"]))
    got = {r["city_id"]: r["action"] for r in insight.refresh_plan(readings, cities, cache, AS_OF).collect()}
    assert got == {"leeds": "serve_cached", "derby": "extend"}
    forced = {r["action"] for r in insight.refresh_plan(readings, cities, cache, AS_OF, force=True).collect()}
    assert forced == {"regenerate"}


def test_cache_table(spark, tmp_path):
    path = str(tmp_path / "insights")
    texts = spark.createDataFrame([("derby", "text", "h", "writer", 100, 10), ("york", "text", "h", "writer", 50, 5)],
                                  "city_id string, insight_text string, context_hash string, model_used string, "
                                  "input_tokens int, output_tokens int")
    for day in (AS_OF, AS_OF + timedelta(days=1)):
        insights.append_insights(insights.new_insights(texts, day), path)
    cache = insights.read_insights(spark, path)
    assert cache.count() == 4
    later = AS_OF + timedelta(days=1, minutes=30)
    assert insights.latest_insights(cache, later).count() == 2
    assert insights.latest_insights(cache, later + timedelta(hours=1)).count() == 0
    old = insights.latest_insights(cache.where("city_id = 'york'"), later, allow_expired=True).select("id", "generated_date")
    insights.extend_insights(spark, old, path, later + timedelta(days=3))
    fresh = insights.latest_insights(insights.read_insights(spark, path), later + timedelta(days=3, minutes=1))
    assert [r["city_id"] for r in fresh.collect()] == ["york"]
    assert insights.read_insights(spark, path).count() == 4
    audit = {(r["city_id"], str(r["day"])): (r["input_tokens"], r["output_tokens"], r["insights"])
             for r in insights.token_audit(insights.read_insights(spark, path)).collect()}
    assert audit[("derby", "2026-02-21")] == (100, 10, 1) and len(audit) == 4
    feed = {r["city_id"]: r["expired"] for r in insight.insight_feed(
        seed_cities(spark), insights.read_insights(spark, path), later + timedelta(days=5)).collect()}
    assert feed == {"derby": True}
