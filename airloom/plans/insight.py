"""Per-city context for a written briefing, and the decision whether a new briefing is needed."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airloom.functions.labels import movement
from airloom.functions.numeric import percent_change, round_exact, share_percent
from airloom.functions.times import days_before, instant, period_label, to_utc
from airloom.operators.filters import active, between_instants, city_names, usable_readings
from airloom.operators.rolling import rolling_baseline
from airloom.operators.surroundings import surroundings, wide_entries
from airloom.plans.anomalies import deviates, with_scores
from airloom.plans.compare import two_period_statistics
from airloom.plans.correlation import paired_statistics
from airloom.schemas import CONTEXT_PAIRS, MISSING, SERIES_KEY, SUSPECT, VALID
from airloom.sources.insights import CACHE_TTL_SECONDS, latest_insights

PERIOD_DAYS = 7
SENSITIVITY = 2.0
TOP_ANOMALIES = 5
WINDOW_HOURS = 3

CONTEXT_FIELDS = ["city", "country", "period", "statistics", "anomalies", "correlations", "data_quality"]


def _statistics(rows: DataFrame) -> DataFrame:
    change = round_exact(percent_change(F.col("avg"), F.col("prev_avg"), places=None), 1)
    return rows.withColumn("trend_pct_change", change).withColumn(
        "trend_direction", movement(F.col("trend_pct_change"), absent="insufficient_data"))


_STATISTICS = ["avg", "min", "max", "reading_count", "trend_direction", "trend_pct_change"]


def context_statistics(readings: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Seven-day statistics per city and parameter, with the trend against the seven days before."""
    now = to_utc(as_of)
    base = usable_readings(readings, since=days_before(now, 2 * PERIOD_DAYS))
    rows = two_period_statistics(base, days_before(now, PERIOD_DAYS), 2).where(F.col("reading_count") > 0)
    return _statistics(rows).select(*SERIES_KEY, *_STATISTICS)


def context_anomalies(readings: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """The five most extreme anomalies of every city over all its parameters."""
    analysis = days_before(to_utc(as_of), PERIOD_DAYS)
    base = usable_readings(readings, since=days_before(analysis, 7)).select(*SERIES_KEY, "timestamp", "value")
    scored = rolling_baseline(base)
    found = with_scores(scored.where((F.col("timestamp") >= instant(analysis)) & deviates(SENSITIVITY)), places=2)
    most_extreme = W.partitionBy("city_id").orderBy(F.col("size").desc(), "timestamp", "parameter")
    return (
        found.withColumn("position", F.row_number().over(most_extreme).cast("long"))
        .where(F.col("position") <= TOP_ANOMALIES)
        .select("city_id", "position", "timestamp", "parameter", "value", "rolling_avg", "z_score")
    )


def _near(readings: DataFrame, moments: DataFrame, moment_key: list[str], now: datetime) -> DataFrame:
    since = days_before(now, PERIOD_DAYS) - timedelta(hours=WINDOW_HOURS)
    return surroundings(moments, usable_readings(readings, since=since), moment_key=moment_key, hours=WINDOW_HOURS)


def context_windows(readings: DataFrame, top: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """All parameters of the city around each of its top anomalies: the last seven timestamps of +-3 hours."""
    near = _near(readings, top.select("city_id", "position", "timestamp"), ["position"], to_utc(as_of))
    return wide_entries(near, ["city_id", "position"])


def anomalies_with_windows(readings: DataFrame, top: DataFrame, now: datetime) -> DataFrame:
    """One list of anomalies per city, each with its window.

    The anomaly travels through the interval join as part of the key, so the rolling baseline behind ``top``
    is evaluated once. None is lost on the way: every anomaly lies within its own window.
    """
    details = F.struct("parameter", "value", "rolling_avg", "z_score").alias("anomaly")
    near = _near(readings, top.select("city_id", "position", "timestamp", details), ["position", "anomaly"], now)
    key = ["city_id", "position", "moment", "anomaly"]
    entry = F.struct("timestamp", F.map_entries("values").alias("values"))
    windows = wide_entries(near, key).groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("context_window"))
    listed = F.struct("position", F.col("moment").alias("timestamp"), "anomaly.*", "context_window")
    return windows.groupBy("city_id").agg(F.sort_array(F.collect_list(listed)).alias("anomalies"))


def context_correlations(readings: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """The two fixed pairs; a pair without a coefficient is left out."""
    base = usable_readings(readings, since=days_before(to_utc(as_of), PERIOD_DAYS))
    return paired_statistics(base, CONTEXT_PAIRS, 4).where(F.col("pearson_r").isNotNull())


def data_quality(readings: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """How many readings of the period there are and how they are flagged."""
    recent = between_instants(readings, days_before(to_utc(as_of), PERIOD_DAYS))
    flag = F.col("quality_flag")
    counted = recent.groupBy("city_id").agg(
        F.count(F.lit(1)).alias("total_readings"), F.count_if(flag == VALID).alias("valid"),
        F.count_if(flag == SUSPECT).alias("suspect"), F.count_if(flag == MISSING).alias("missing"))
    return counted.select("city_id", "total_readings",
                          share_percent(F.col("valid"), F.col("total_readings")).alias("valid_pct"),
                          "suspect", "missing")


def insight_context(readings: DataFrame, cities: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """One row per active city with everything a briefing is written from, and its content hash.

    The lists are short by construction: one entry per parameter, five anomalies with seven timestamps
    each, two correlations.
    """
    now = to_utc(as_of)
    recent = F.col("timestamp") >= instant(days_before(now, PERIOD_DAYS))
    flag = F.col("quality_flag")
    measured = two_period_statistics(
        between_instants(readings, days_before(now, 2 * PERIOD_DAYS)), days_before(now, PERIOD_DAYS), 2,
        usable=flag == VALID,
        extra=[F.count_if(recent).alias("total"), F.count_if(recent & (flag == SUSPECT)).alias("suspect"),
               F.count_if(recent & (flag == MISSING)).alias("missing")])
    # collect_list passes over the NULLs of parameters without a current reading.
    entry = F.when(F.col("reading_count") > 0, F.struct("parameter", F.struct(*_STATISTICS)))
    overview = _statistics(measured).groupBy("city_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("statistics"),
        F.sum("total").alias("total_readings"), F.sum("reading_count").alias("valid"),
        F.sum("suspect").alias("suspect"), F.sum("missing").alias("missing"))
    valid_pct = share_percent(F.col("valid"), F.col("total_readings")).alias("valid_pct")
    overview = overview.select("city_id", "statistics",
                               F.struct("total_readings", valid_pct, "suspect", "missing").alias("data_quality"))
    # Anomalies of inactive cities would not be reported.
    ours = active(cities).select(F.col("id").alias("city_id"))
    top = context_anomalies(readings, now).join(ours, "city_id", "left_semi")
    anomalies = anomalies_with_windows(readings, top, now)
    correlations = context_correlations(readings, now).groupBy("city_id").agg(
        F.sort_array(F.collect_list(F.struct("param1", "param2", "pearson_r", "sample_size"))).alias("correlations"))
    zero = F.lit(0).cast("long")
    no_data = F.struct(zero.alias("total_readings"), F.lit(0.0).alias("valid_pct"), zero.alias("suspect"),
                       zero.alias("missing"))
    joined = (
        city_names(cities, "country")
        .join(overview, "city_id", "left").join(anomalies, "city_id", "left").join(correlations, "city_id", "left")
    )
    label = period_label(days_before(now, PERIOD_DAYS), now)
    context = joined.select(
        "city_id", F.col("city_name").alias("city"), "country", F.lit(label).alias("period"),
        F.coalesce("statistics", F.create_map().cast(overview.schema["statistics"].dataType)).alias("statistics"),
        F.coalesce("anomalies", F.array().cast(anomalies.schema["anomalies"].dataType)).alias("anomalies"),
        F.coalesce("correlations", F.array().cast(correlations.schema["correlations"].dataType)
                   ).alias("correlations"),
        F.coalesce("data_quality", no_data).alias("data_quality"),
    )
    return with_hash(context)


def with_hash(context: DataFrame) -> DataFrame:
    """SHA-256 over the context as JSON; its fields, maps and lists all have a fixed order."""
    return context.withColumn("context_hash", F.sha2(F.to_json(F.struct(*CONTEXT_FIELDS)), 256))


def insight_flags(context: DataFrame) -> DataFrame:
    """The rules a briefing follows, as columns: high deviation, thermal inversion, rising PM2.5."""
    inversion = F.exists("correlations", lambda c: (c["param1"] == "pm25") & (c["param2"] == "temperature")
                         & (c["pearson_r"] < -0.4))
    pm25 = F.try_element_at("statistics", F.lit("pm25"))
    return context.select(
        "city_id",
        F.exists("anomalies", lambda a: a["z_score"] >= 3.0).alias("concern_flag"),
        inversion.alias("inversion_flag"),
        F.coalesce((pm25["trend_direction"] == "rising") & (pm25["trend_pct_change"] > 10), F.lit(False)
                   ).alias("action_flag"),
    )


def cache_decisions(contexts: DataFrame, cache: DataFrame, as_of: datetime | str | None = None, *,
                    ttl_seconds: int = CACHE_TTL_SECONDS, force: bool = False) -> DataFrame:
    """What to do for each city with a context (city_id, context_hash).

    serve_cached: an unexpired insight exists. extend: the newest one has expired but was written from the
    same content. regenerate: anything else, and always with ``force``. ``fallback_insight_id`` is the
    newest insight whatever its age.
    """
    now = to_utc(as_of)
    stored = F.struct("generated_at", "id", "context_hash", "expires_at")
    known = cache.groupBy("city_id").agg(
        F.max(stored).alias("newest"),
        F.max(F.when(F.col("expires_at") > instant(now), stored)).alias("fresh"))
    same = F.coalesce(F.col("newest.context_hash") == F.col("context_hash"), F.lit(False))
    action = (
        F.when(F.lit(force), "regenerate")
        .when(F.col("fresh").isNotNull(), "serve_cached")
        .when(same, "extend")
        .otherwise("regenerate")
    )
    renewed = instant(now + timedelta(seconds=ttl_seconds))
    return contexts.select("city_id", "context_hash").join(known, "city_id", "left").withColumn("action", action).select(
        "city_id", "context_hash", "action",
        F.when(F.col("action") == "serve_cached", F.col("fresh.expires_at"))
        .when(F.col("action") == "extend", renewed).alias("expires_at"),
        F.col("newest.id").alias("fallback_insight_id"),
    )


def refresh_plan(readings: DataFrame, cities: DataFrame, cache: DataFrame, as_of: datetime | str | None = None, *,
                 ttl_seconds: int = CACHE_TTL_SECONDS, force: bool = False) -> DataFrame:
    """Cache decisions for all active cities; contexts are computed only where no unexpired insight exists."""
    now = to_utc(as_of)
    pending = active(cities)
    served = None
    if not force:
        fresh = latest_insights(cache, now).select("city_id", "id", "context_hash", "expires_at")
        served = fresh.join(active(cities).select(F.col("id").alias("city_id")), "city_id", "left_semi")
        pending = pending.join(served.select(F.col("city_id").alias("id")), "id", "left_anti")
    wanted = readings.join(pending.select(F.col("id").alias("city_id")), "city_id", "left_semi")
    decided = cache_decisions(insight_context(wanted, pending, now), cache, now,
                              ttl_seconds=ttl_seconds, force=force)
    if served is None:
        return decided
    return decided.unionByName(served.select(
        "city_id", "context_hash", F.lit("serve_cached").alias("action"), "expires_at",
        F.col("id").alias("fallback_insight_id")))


def insight_feed(cities: DataFrame, cache: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """The stored insight of every active city, expired ones marked: what readers get while no new text exists."""
    now = to_utc(as_of)
    newest = latest_insights(cache, now, allow_expired=True)
    return city_names(cities).join(newest, "city_id").select(
        "city_id", "city_name", F.col("insight_text").alias("insight"), "generated_at", "expires_at", "model_used",
        (F.col("expires_at") <= instant(now)).alias("expired"))
