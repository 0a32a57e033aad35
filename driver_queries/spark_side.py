"""The registered queries: every operator applied to the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from airloom.functions.labels import correlation_direction, correlation_strength, pm25_category, severity
from airloom.functions.quality import canonical_unit, normalise_weather, quality_flag
from airloom.functions.text import lookup_slug, site_errors, slug
from airloom.functions.times import first_present, parse_hourly, parse_iso, to_utc
from airloom.operators import sites as dimension
from airloom.operators.constraints import constraint_violations
from airloom.operators.filters import changed_since
from airloom.operators.places import nearest_stations
from airloom.operators.rolling import rolling_baseline
from airloom.operators.surroundings import surroundings
from airloom.operators.upsert import flag_readings, latest_per_key, merge_readings, reprocess
from airloom.functions.numeric import round_half_up
from airloom.plans import anomalies as anomaly_plan
from airloom.plans import compare as compare_plan
from airloom.plans import correlation as correlation_plan
from airloom.plans import ingest as ingest_plan
from airloom.plans import insight as insight_plan
from airloom.plans import lookup, summary
from airloom.plans.documents import to_documents
from airloom.plans.trend import trend
from airloom.schemas import LOCATIONS_DOC, MEASUREMENTS_DOC, READING_KEY, READINGS, VALID, WEATHER_DOC
from airloom.session import apply_settings, ensure_checkpoint_folder, work_folder
from airloom.sources import insights, landed, tables
from airloom.streaming.baseline import current_scores, read_scores, score_writer
from airloom.streaming.ingest import cycle_stream, document_stream, read_cycles, upsert_stream
from airloom.streaming.trend import read_trend, stream_trend, trend_writer
from airloom.operators.filters import usable_readings
from driver_queries import tables as given
from driver_queries.tables import AS_OF

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def without_zone(df: DataFrame) -> DataFrame:
    """Timestamps as wall-clock values in UTC, the type the test tables use."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in df.schema])


def registered(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return without_zone(query(ensure_checkpoint_folder(apply_settings(spark)), folder))

    QUERIES[query.__name__] = run
    return run


# Trend

def _trend(interval: str) -> Query:
    return lambda spark, d: trend(given.readings(spark, d), given.cities(spark, d), as_of=AS_OF, interval=interval)


for _interval in ("hour", "day", "week"):
    _query = _trend(_interval)
    _query.__name__ = f"trend_{_interval}"
    registered(_query)


@registered
def trend_keep_empty(spark, d):
    """Cities without recent readings of a parameter still get an answer."""
    recent = given.readings(spark, d).where("parameter <> 'humidity' OR value > 80")
    return trend(recent, given.cities(spark, d), as_of=AS_OF, days=2,
                 parameters=["humidity", "o3"], keep_empty=True)


@registered
def trend_with_suspect(spark, d):
    return trend(given.readings(spark, d), given.cities(spark, d), as_of=AS_OF, parameters=["temperature"],
                 include_suspect=True, until=to_utc("2024-01-20"))


@registered
def trend_documents(spark, d):
    """Trend responses as JSON documents, read back into rows."""
    rows = trend(given.readings(spark, d), given.cities(spark, d), as_of=AS_OF, sort=False)
    documents = to_documents(rows, ["city_id", "parameter", "unit", "interval", "days", "total_readings"],
                             ["period", "avg", "min", "max", "reading_count"], "data")
    schema = ("city_id string, parameter string, unit string, interval string, days int, total_readings long, "
              "data array<struct<period: timestamp, avg: double, min: double, max: double, reading_count: long>>")
    read = documents.select(F.from_json("document", schema).alias("d")).select("d.*")
    return read.select("city_id", "parameter", "unit", "interval", "days", "total_readings", F.inline("data"))


# Comparison and ranking

@registered
def compare(spark, d):
    return compare_plan.compare(given.readings(spark, d), given.cities(spark, d), as_of=AS_OF)


@registered
def compare_selected(spark, d):
    """Comparison of named cities, one of them inactive."""
    return compare_plan.compare(given.readings(spark, d), given.cities(spark, d), as_of=AS_OF, days=3,
                                city_ids=["1", "2", "3", "4"])


@registered
def compare_summary(spark, d):
    requests = given.cities(spark, d).select(F.col("id").cast("long").alias("request_seq"),
                                             F.lower("name").alias("requested_name"))
    return summary.compare_summary(given.readings(spark, d), given.cities(spark, d), requests, as_of=AS_OF)


@registered
def ranking(spark, d):
    return compare_plan.ranking(given.readings(spark, d), given.cities(spark, d), as_of=AS_OF)


@registered
def ranking_country(spark, d):
    return compare_plan.ranking(given.readings(spark, d), given.cities(spark, d), as_of=AS_OF, days=30, country="eu")


@registered
def ranking_all(spark, d):
    return compare_plan.ranking(given.readings(spark, d), given.cities(spark, d), as_of=AS_OF, days=30,
                                limit=None, min_readings=1)


# Anomalies

@registered
def anomalies(spark, d):
    return anomaly_plan.anomalies(given.readings(spark, d), given.cities(spark, d), as_of=AS_OF)


@registered
def anomalies_sliced(spark, d):
    """The same with blocks so short that every series is cut."""
    return anomaly_plan.anomalies(given.readings(spark, d), given.cities(spark, d), as_of=AS_OF,
                                  block_frames=1, sort=True)


@registered
def anomaly_totals(spark, d):
    return anomaly_plan.anomaly_totals(given.readings(spark, d), given.cities(spark, d), as_of=AS_OF,
                                       sensitivity=3.0)


@registered
def rolling_windows(spark, d):
    base = usable_readings(given.readings(spark, d)).select(*READING_KEY, "value")
    scored = rolling_baseline(base, block_frames=2, frame_rows=20)
    return scored.select(*READING_KEY, round_half_up(F.col("rolling_avg"), 6).alias("rolling_avg"),
                         round_half_up(F.col("rolling_stddev"), 6).alias("rolling_stddev"), "window_size")


@registered
def anomaly_summary(spark, d):
    rows = summary.anomaly_summary(given.readings(spark, d), given.cities(spark, d), as_of=AS_OF)
    return rows.select("city_id", "city_name", "total", "high", "medium", "low",
                       F.size("top_anomalies").cast("long").alias("shown"),
                       F.get("top_anomalies", F.lit(0))["z_score"].alias("first_z"),
                       F.get("top_anomalies", F.lit(0))["parameter"].alias("first_parameter"))


@registered
def anomaly_summary_entries(spark, d):
    rows = summary.anomaly_summary(given.readings(spark, d), given.cities(spark, d), as_of=AS_OF)
    return rows.select("city_id", F.inline("top_anomalies")).withColumn("position", F.col("position").cast("long"))


# Correlation

@registered
def correlation(spark, d):
    return correlation_plan.correlation(given.hourly_readings(spark, d), given.cities(spark, d), "pm25",
                                        "temperature", as_of=AS_OF)


@registered
def correlation_matrix(spark, d):
    pairs = correlation_plan.all_pairs([*given.PARAMETERS.values(), "o3"])
    return correlation_plan.correlations(given.hourly_readings(spark, d), given.cities(spark, d), pairs, as_of=AS_OF)


# Summaries, health, look-up

@registered
def air_quality_summary(spark, d):
    return summary.air_quality_summary(given.readings(spark, d), given.cities(spark, d), as_of=AS_OF)


@registered
def health(spark, d):
    return lookup.health(given.readings(spark, d), as_of=AS_OF)


def _stored(spark: SparkSession, d: str, purpose: str) -> str:
    """A table of all readings, stored in two commits."""
    path = work_folder(spark, purpose)
    rows = given.readings(spark, d)
    for early in (True, False):
        part = rows.where((F.dayofmonth("timestamp") <= 15) == early)
        tables.store_readings(spark, part.select(*READINGS.fieldNames()), path)
    return path


@registered
def health_from_log(spark, d):
    """Answered from the log of the table; the readings are not read."""
    return lookup.health(tables.reading_log(spark, _stored(spark, d, "health")), as_of=AS_OF)


@registered
def freshness_from_log(spark, d):
    log = tables.reading_log(spark, _stored(spark, d, "freshness"))
    return lookup.freshness(log, given.cities(spark, d), as_of="2024-01-31T02:00:00Z")


@registered
def changed_from_log(spark, d):
    """Changed rows from the days that the log names."""
    rows = tables.changed_readings(spark, _stored(spark, d, "changed"), to_utc("2024-01-15T12:00:00Z"))
    return rows.select("id", "city_id", "parameter", "value", "updated_at")


@registered
def freshness(spark, d):
    return lookup.freshness(given.readings(spark, d), given.cities(spark, d), as_of="2024-01-31T02:00:00Z")


@registered
def readings_range(spark, d):
    return lookup.readings_range(given.readings(spark, d), start="2024-01-10", end="2024-01-20",
                                 include_suspect=True)


@registered
def readings_page(spark, d):
    rows = lookup.readings_range(given.readings(spark, d), start="2024-01-10", end="2024-01-20")
    return lookup.readings_page(rows, skip=50, limit=100)


@registered
def readings_deep_page(spark, d):
    """A page far from the start, cut out of sorted slices."""
    rows = lookup.readings_range(given.readings(spark, d), start="2024-01-01", end="2024-02-01")
    return lookup.readings_deep_page(rows, skip=600, limit=200)


@registered
def readings_next_page(spark, d):
    """The page after a given reading."""
    rows = lookup.readings_range(given.readings(spark, d), start="2024-01-01", end="2024-02-01")
    return lookup.readings_page(rows, limit=100, after=(to_utc("2024-01-22T12:00:00Z"), "12", "no2"))


@registered
def readings_changed_since(spark, d):
    rows = changed_since(given.readings(spark, d), to_utc("2024-01-15T12:00:00Z"))
    return rows.select("id", "city_id", "parameter", "value", "updated_at")


@registered
def bound_sql(spark, d):
    """SQL text with bound parameters over the registered views."""
    tables.register_views(given.readings(spark, d), given.cities(spark, d))
    return tables.run_sql(spark, """
        SELECT c.country, r.parameter, count(*) AS readings, round(max(r.value), 2) AS highest
        FROM readings r JOIN cities c ON c.id = r.city_id
        WHERE r.quality_flag = :flag AND r.timestamp >= CAST(:since AS TIMESTAMP)
        GROUP BY c.country, r.parameter""", {"flag": VALID, "since": "2024-01-10 00:00:00"})


# Scalar functions

@registered
def quality_flags(spark, d):
    staged = given.as_staged(given.table(spark, d, "events"))
    return flag_readings(staged).select("id", "parameter", "value", "quality_flag", "unit")


@registered
def unit_normalise(spark, d):
    unit = F.when(F.col("event_type") == "view", "m/s").otherwise("km/h")
    parameter = F.when(F.col("event_type") == "click", "temperature").otherwise("wind_speed")
    value = normalise_weather(parameter, F.col("value"), unit)
    return given.table(spark, d, "events").select("event_id", value.alias("value"),
                                                  canonical_unit(parameter).alias("unit"))


@registered
def parse_timestamps(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.concat(stamp, F.lit("Z")))
        .when(kind == "click", F.concat(stamp, F.lit("+02:00")))
        .when(kind == "purchase", F.concat(F.lit("  "), F.substring(stamp, 1, 16), F.lit(" ")))
        .when(kind == "error", stamp)
        .otherwise(F.concat(F.lit("at "), stamp))
    )
    fallback = first_present(F.when(kind == "view", F.lit("")).otherwise(text), F.concat(stamp, F.lit("Z")))
    return given.table(spark, d, "events").select(
        "event_id", parse_iso(text).alias("parsed"), parse_iso(fallback).alias("with_fallback"),
        parse_hourly(F.when(kind == "error", stamp).otherwise(F.substring(stamp, 1, 16))).alias("hourly"))


@registered
def slugify(spark, d):
    """Slugs of all document sources, part names and customer names."""
    names = (
        given.table(spark, d, "part").select(F.concat_ws(" _ ", "p_name", "p_brand").alias("name"))
        .unionByName(given.table(spark, d, "customer").select(F.concat(F.lit(" São "), "c_name").alias("name")))
        .unionByName(given.table(spark, d, "documents").select(F.concat_ws("--", "source", "lang").alias("name")))
    )
    return names.select("name", slug(F.col("name")).alias("slug"), lookup_slug(F.col("name")).alias("lookup_slug"))


@registered
def labels(spark, d):
    """Severity, correlation words and PM2.5 classes over all readings."""
    value = F.col("value")
    r = (value - 100) / 150
    return given.table(spark, d, "events").select(
        "event_id", severity(value / 20).alias("severity"), correlation_strength(r).alias("strength"),
        correlation_direction(r).alias("direction"), pm25_category(value).alias("aqi_category"))


@registered
def site_checks(spark, d):
    rows = given.site_candidates(spark, d)
    return rows.select("request_seq", F.array_join(site_errors(), ",").alias("errors"))


# Sources

def _through_json(documents: DataFrame, schema: T.StructType) -> DataFrame:
    text = documents.select(F.to_json(F.struct(*documents.columns)).alias("value"))
    return text.select(F.from_json("value", schema).alias("document")).select("document.*")


def _staged(rows: DataFrame) -> DataFrame:
    return rows.select("city_id", "parameter", "value", "unit", "raw_value", "raw_unit", "timestamp", "source",
                       "ingest_seq")


@registered
def weather_readings(spark, d):
    return _staged(landed.parse_weather(_through_json(given.weather_documents(spark, d), WEATHER_DOC)))


@registered
def weather_readings_recent(spark, d):
    documents = given.weather_documents(spark, d)
    return _staged(landed.parse_weather(documents, to_utc("2024-01-29T12:00:00Z")))


@registered
def first_sensor(spark, d):
    return landed.chosen_sensors(_through_json(given.location_documents(spark, d), LOCATIONS_DOC))


@registered
def air_quality_readings(spark, d):
    sensors = landed.chosen_sensors(given.location_documents(spark, d))
    documents = _through_json(given.measurement_documents(spark, d), MEASUREMENTS_DOC)
    return _staged(landed.parse_measurements(documents, sensors))


@registered
def nearest(spark, d):
    places = lambda rows, key, nation: rows.select(
        F.col(key).alias("key"), (F.col(key[0] + "_acctbal") / 200.0).alias("latitude"),
        (F.col(nation) * 0.04).alias("longitude"))
    centres = places(given.table(spark, d, "supplier"), "s_suppkey", "s_nationkey").withColumnRenamed("key", "city_id")
    stations = places(given.table(spark, d, "customer"), "c_custkey", "c_nationkey").withColumnRenamed(
        "key", "station_id")
    found = nearest_stations(centres, stations)
    return found.withColumn("distance_km", round_half_up(F.col("distance_km"), 6))


# Upsert and ingest

def _corrections(spark, d) -> DataFrame:
    """Everything measured since mid-January arrives again: clicks raised, errors blank, views twice."""
    late = given.as_staged(given.table(spark, d, "events")).where("timestamp >= TIMESTAMP'2024-01-15'")
    value = (
        F.when(F.col("parameter") == "pm10", F.col("value") + 1)
        .when(F.col("parameter") != "temperature", F.col("value"))
    )
    again = late.withColumn("value", value).withColumn("unit", F.lit("changed"))
    twice = late.where("parameter = 'pm25'").withColumns({
        "value": F.col("value") * 2, "ingest_seq": F.col("ingest_seq") + 1_000_000_000_000})
    return flag_readings(again.unionByName(twice))


def _merged(spark, d) -> DataFrame:
    stored = given.readings(spark, d).where("timestamp < TIMESTAMP'2024-01-20'")
    return merge_readings(stored.drop("ingest_seq"), _corrections(spark, d), to_utc(AS_OF))


@registered
def upsert_merge(spark, d):
    return _merged(spark, d).select(*READING_KEY, "value", "unit", "quality_flag", "created_at", "updated_at",
                                    "action")


@registered
def upsert_table(spark, d):
    """Two upserts and a replay into a partitioned table, then the table."""
    path = work_folder(spark, "upsert")
    staged = flag_readings(given.as_staged(given.table(spark, d, "events")))
    tables.upsert_readings(spark, staged.where("timestamp < TIMESTAMP'2024-01-20'"), path, to_utc("2024-01-20"))
    corrections = _corrections(spark, d)
    tables.upsert_readings(spark, corrections, path, to_utc(AS_OF))
    tables.upsert_readings(spark, corrections, path, to_utc("2024-02-01"))
    return tables.read_readings(spark, path).select(*READING_KEY, "value", "unit", "quality_flag", "updated_at")


@registered
def batch_deduplicated(spark, d):
    rows = latest_per_key(_corrections(spark, d))
    return rows.select(*READING_KEY, "value", "unit", "quality_flag", "ingest_seq")


@registered
def reprocessed(spark, d):
    """Raw values kept in km/h under a wrong flag are computed again."""
    raw = given.readings(spark, d).withColumns({
        "parameter": F.when(F.col("parameter") == "pm10", "wind_speed").otherwise(F.col("parameter")),
        "raw_unit": F.when(F.col("parameter") == "pm10", "km/h").otherwise(F.col("raw_unit")),
        "raw_value": F.col("raw_value") * 2, "quality_flag": F.lit(VALID)})
    return reprocess(raw).select("id", "parameter", "value", "unit", "quality_flag")


@registered
def constraint_violations_found(spark, d):
    """Corrections stored without a merge, next to a dimension that lacks the inactive cities."""
    rows = given.readings(spark, d).select(*READING_KEY, "value", "quality_flag").unionByName(
        _corrections(spark, d).select(*READING_KEY, "value", "quality_flag"))
    rows = rows.withColumn("quality_flag", F.when(F.col("value") > 400, "odd").otherwise(F.col("quality_flag")))
    rows = rows.withColumn("value", F.when(F.col("value") < 1, None).otherwise(F.col("value")))
    return constraint_violations(rows, given.cities(spark, d).where("is_active"))


def _cycle(spark, d) -> DataFrame:
    return ingest_plan.stage_readings(
        given.cities(spark, d), landed.parse_weather(given.weather_documents(spark, d)),
        given.as_staged(given.table(spark, d, "events")))


@registered
def ingest_stats(spark, d):
    return ingest_plan.ingest_stats(_cycle(spark, d), given.cities(spark, d))


@registered
def cycle_report(spark, d):
    """The report on the upsert of corrections, with the cities of Asia failing."""
    cities = given.cities(spark, d)
    errors = cities.where("country = 'ASIA'").select(F.col("id").alias("city_id"), F.lit("timeout").alias("error"))
    return ingest_plan.cycle_report(cities, ingest_plan.merge_counts(_merged(spark, d)), errors)


@registered
def merge_counts(spark, d):
    return ingest_plan.merge_counts(_merged(spark, d))


# City dimension

@registered
def sites_review(spark, d):
    reviewed = dimension.review_candidates(given.sites(spark, d), given.site_candidates(spark, d))
    return reviewed.select("request_seq", "name", "slug", "reason")


@registered
def sites_create(spark, d):
    return dimension.create_sites(given.sites(spark, d), given.site_candidates(spark, d), to_utc(AS_OF))


@registered
def sites_patch_review(spark, d):
    return dimension.review_patches(given.sites(spark, d), given.site_patches(spark, d)).select(
        "id", "name", "latitude", "timezone", "reason")


@registered
def sites_update(spark, d):
    return dimension.update_sites(given.sites(spark, d), given.site_patches(spark, d), to_utc(AS_OF))


@registered
def sites_delete(spark, d):
    return dimension.delete_sites(given.sites(spark, d), given.site_deletions(spark, d), to_utc(AS_OF))


@registered
def sites_found(spark, d):
    return dimension.find_sites(given.sites(spark, d), given.site_deletions(spark, d)).select("id", "name")


@registered
def sites_missing(spark, d):
    return dimension.missing_sites(given.sites(spark, d), given.site_deletions(spark, d))


@registered
def sites_page(spark, d):
    return dimension.site_page(given.sites(spark, d), skip=20, limit=50).select("id", "name", "country")


@registered
def sites_page_info(spark, d):
    return dimension.site_page_info(given.sites(spark, d), skip=20, limit=50)


@registered
def active_sites(spark, d):
    return dimension.available_sites(given.sites(spark, d)).select("id", "name")


@registered
def resolve_names(spark, d):
    return dimension.resolve_names(given.sites(spark, d), given.name_requests(spark, d))


@registered
def unresolved_names(spark, d):
    return dimension.unresolved_names(dimension.resolve_names(given.sites(spark, d), given.name_requests(spark, d)))


# Insight context and cache

@registered
def context_statistics(spark, d):
    return insight_plan.context_statistics(given.hourly_readings(spark, d), AS_OF)


@registered
def context_anomalies(spark, d):
    return insight_plan.context_anomalies(given.hourly_readings(spark, d), AS_OF)


@registered
def context_windows(spark, d):
    rows = given.hourly_readings(spark, d)
    windows = insight_plan.context_windows(rows, insight_plan.context_anomalies(rows, AS_OF), AS_OF)
    return windows.select("city_id", "position", "timestamp", F.explode("values").alias("parameter", "value")
                          ).withColumn("value", round_half_up(F.col("value"), 6))


@registered
def surroundings_of_peaks(spark, d):
    """What else each city measured around its readings above 350."""
    rows = usable_readings(given.readings(spark, d))
    peaks = rows.where("value > 350").select("city_id", "timestamp", F.col("id").alias("peak_id"))
    near = surroundings(peaks, rows, moment_key=["peak_id"])
    return near.select("city_id", "peak_id", "timestamp", "parameter", "value")


@registered
def context_correlations(spark, d):
    return insight_plan.context_correlations(given.hourly_readings(spark, d), AS_OF)


@registered
def data_quality(spark, d):
    return insight_plan.data_quality(given.readings(spark, d), AS_OF)


@registered
def insight_context(spark, d):
    rows = insight_plan.insight_context(given.hourly_readings(spark, d), given.cities(spark, d), AS_OF)
    pm25 = F.try_element_at("statistics", F.lit("pm25"))
    return rows.select(
        "city_id", "city", "country", "period", F.size("statistics").cast("long").alias("parameters"),
        pm25["avg"].alias("pm25_avg"), F.size("anomalies").cast("long").alias("anomalies"),
        F.size("correlations").cast("long").alias("correlations"),
        F.col("data_quality.total_readings").alias("total_readings"),
        F.col("data_quality.valid_pct").alias("valid_pct"))


@registered
def insight_context_hash(spark, d):
    return insight_plan.insight_context(given.hourly_readings(spark, d), given.cities(spark, d), AS_OF).select(
        "city_id", "context_hash")


@registered
def insight_flags(spark, d):
    return insight_plan.insight_flags(
        insight_plan.insight_context(given.hourly_readings(spark, d), given.cities(spark, d), AS_OF))


CACHE_AS_OF = "2001-08-20T00:00:00Z"


def _contexts(spark, d) -> DataFrame:
    """A content hash per city that equals some stored ones: the smallest status among its newest orders."""
    cache = given.insight_cache(spark, d)
    days = cache.where("generated_at >= TIMESTAMP'2001-07-01'").groupBy("city_id").agg(
        F.min("context_hash").alias("context_hash"))
    return given.cities(spark, d).select(F.col("id").alias("city_id")).join(days, "city_id", "left").select(
        "city_id", F.coalesce("context_hash", F.lit("none")).alias("context_hash"))


@registered
def cache_decisions(spark, d):
    return insight_plan.cache_decisions(_contexts(spark, d), given.insight_cache(spark, d), CACHE_AS_OF)


@registered
def cache_decisions_expired(spark, d):
    return insight_plan.cache_decisions(_contexts(spark, d), given.insight_cache(spark, d), "2002-01-01")


@registered
def refresh_plan(spark, d):
    """Decisions from readings to action, at a time when part of the insights are still good."""
    shifted = given.insight_cache(spark, d).withColumns({
        name: F.col(name) + F.expr("INTERVAL 8217 DAYS") for name in ("generated_at", "expires_at")})
    decided = insight_plan.refresh_plan(given.hourly_readings(spark, d), given.cities(spark, d), shifted, AS_OF)
    return decided.select("city_id", "action", "expires_at", "fallback_insight_id")


@registered
def latest_insights(spark, d):
    return insights.latest_insights(given.insight_cache(spark, d), to_utc(CACHE_AS_OF)).select(
        "city_id", "id", "generated_at", "expires_at")


@registered
def insight_feed(spark, d):
    return insight_plan.insight_feed(given.cities(spark, d), given.insight_cache(spark, d), CACHE_AS_OF)


@registered
def extended_insights(spark, d):
    cache = given.insight_cache(spark, d)
    stale = insights.latest_insights(cache, to_utc("2001-12-01"), allow_expired=True)
    return insights.extended(cache, stale, to_utc("2001-12-01")).select("id", "city_id", "expires_at", "updated_at")


@registered
def token_audit(spark, d):
    return insights.token_audit(given.insight_cache(spark, d)).withColumn("day", F.col("day").cast("string"))


# Streaming

def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = given.table(spark, folder, "events").schema
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/event[s].parquet")


def _deliver_events(spark: SparkSession, d: str, base: str, store: Callable[[DataFrame], DataStreamWriter]) -> None:
    """All events as four deliveries that one stream takes in, one micro-batch each; ``store`` makes its writer.

    Three hold the thirds of the month. A tenth of the readings comes late, in the fourth one, and so do corrections of
    others, which first arrive with another value. A delivery is written and read by as many tasks as there are.
    """
    staged = given.as_staged(given.spread(given.table(spark, d, "events"), "event_id"))
    late, corrected = F.col("ingest_seq") % 10 == 3, F.col("ingest_seq") % 20 == 7
    wrong = F.when(corrected, F.col("value") + 1000).otherwise(F.col("value"))
    third = F.least(F.floor((F.dayofmonth("timestamp") - 1) / 10), F.lit(2))
    for part in (*range(3), None):
        rows = staged.where(late | corrected) if part is None else staged.where(~late & (third == part)).withColumn("value", wrong)
        rows.write.mode("append").parquet(f"{base}/landing")
        arriving = spark.readStream.schema(staged.schema).parquet(f"{base}/landing")
        # The checkpoint tells the stream which files it has had: only the new delivery is left.
        store(arriving).trigger(availableNow=True).start().awaitTermination()


@registered
def stream_upsert(spark, d):
    base = work_folder(spark, "stream-upsert")
    staged = given.as_staged(_event_stream(spark, d))
    upsert_stream(staged, f"{base}/readings", f"{base}/checkpoint", as_of=to_utc(AS_OF)).trigger(
        availableNow=True).start().awaitTermination()
    return tables.read_readings(spark, f"{base}/readings").select(*READING_KEY, "value", "quality_flag")


@registered
def stream_documents(spark, d):
    """Landed weather files, every error event an unreadable line, to the table and the quarantine."""
    base = work_folder(spark, "stream-documents")
    documents = given.weather_documents(spark, d)
    text = F.to_json(F.struct(*documents.columns))
    broken = F.col("hourly_units.wind_speed_10m") == "m/s"
    documents.select(F.when(broken, F.substring(text, 1, 20)).otherwise(text).alias("value")).write.text(
        f"{base}/landing")
    document_stream(
        landed.read_weather(spark, f"{base}/landing", streaming=True), landed.parse_weather, f"{base}/readings",
        f"{base}/quarantine", f"{base}/checkpoint", as_of=to_utc(AS_OF),
    ).trigger(availableNow=True).start().awaitTermination()
    stored = tables.read_readings(spark, f"{base}/readings").select(
        F.col("parameter").alias("kind"), "quality_flag")
    kept = spark.read.text(f"{base}/quarantine").select(F.lit("quarantine").alias("kind"),
                                                        F.lit("unreadable").alias("quality_flag"))
    return stored.unionByName(kept).groupBy("kind", "quality_flag").agg(F.count(F.lit(1)).alias("rows"))


@registered
def stream_cycles(spark, d):
    """Landed weather in ingest cycles: every error event is a failed fetch, and cities of the Middle East are inactive."""
    base = work_folder(spark, "stream-cycles")
    documents = given.weather_documents(spark, d)
    failed = F.col("hourly_units.wind_speed_10m") == "m/s"
    landed_rows = documents.withColumns({
        "error": F.when(failed, F.lit("timeout")), "hourly": F.when(~failed, F.col("hourly")),
        "hourly_units": F.when(~failed, F.col("hourly_units"))})
    landed_rows.repartition(3, "city_id").write.json(f"{base}/landing")
    weather = landed.read_weather(spark, f"{base}/landing", streaming=True)
    cities = given.cities(spark, d)
    cycle_stream({"weather": (weather, landed.parse_weather)}, cities, base, as_of=to_utc(AS_OF)).trigger(
        availableNow=True).start().awaitTermination()
    stats = read_cycles(spark, base, "stats").groupBy("city_id").agg(
        F.sum("readings_fetched").alias("readings_fetched"), F.sum("readings_inserted").alias("readings_inserted"),
        F.sum("quality_missing").alias("quality_missing"))
    errors = read_cycles(spark, base, "errors").groupBy("city_id").agg(F.count(F.lit(1)).alias("fetch_errors"))
    return stats.join(errors, "city_id", "left").fillna(0, ["fetch_errors"])


def _stream_trend(interval: str) -> Query:
    """Buckets kept equal to the batch trend over four deliveries, with late readings and corrections."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        base = work_folder(spark, "stream-trend")
        _deliver_events(spark, d, base, lambda arriving: upsert_stream(
            arriving, f"{base}/readings", f"{base}/checkpoint", as_of=to_utc(AS_OF),
            after=trend_writer(f"{base}/readings", f"{base}/trend", interval)))
        return read_trend(spark, f"{base}/trend")

    run.__name__ = f"stream_trend_{interval}"
    return run


def _closed_trend(interval: str) -> Query:
    """Buckets emitted once, when they can no longer change."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        base = work_folder(spark, "closed-trend")
        arriving = flag_readings(given.as_staged(_event_stream(spark, d)))
        stream_trend(arriving, interval).writeStream.format("parquet").option("path", f"{base}/out").option(
            "checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(
            availableNow=True).start().awaitTermination()
        schema = "city_id string, parameter string, period timestamp, avg double, min double, max double, " \
                 "reading_count long"
        return spark.read.schema(schema).parquet(f"{base}/out")

    run.__name__ = f"closed_trend_{interval}"
    return run


for _interval in ("hour", "day", "week"):
    registered(_stream_trend(_interval))
    registered(_closed_trend(_interval))


@registered
def stream_baseline(spark, d):
    """Rolling scores kept next to the table by the ingest stream, over four files with late readings and corrections."""
    base = work_folder(spark, "stream-baseline")
    _deliver_events(spark, d, base, lambda arriving: upsert_stream(
        arriving, f"{base}/readings", f"{base}/checkpoint", as_of=to_utc(AS_OF),
        after=score_writer(f"{base}/readings", f"{base}/scores", f"{base}/tails")))
    current = current_scores(tables.read_readings(spark, f"{base}/readings"), read_scores(spark, f"{base}/scores"))
    return current.select(*READING_KEY, "value", "rolling_avg", "rolling_stddev", "z_score", "window_size")
