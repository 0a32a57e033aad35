import math
import random
import statistics
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from airloom.operators import positions
from airloom.operators.filters import changed_since
from airloom.operators.places import EARTH_RADIUS_KM, nearest_stations
from airloom.operators.rolling import PLACE, framed, placed_rows, rolling_baseline
from airloom.plans.anomalies import anomalies, anomaly_totals
from airloom.plans.compare import compare, ranking
from airloom.plans.correlation import correlation, correlations
from airloom.plans.documents import to_documents
from airloom.plans.lookup import freshness, health, readings_page, readings_range
from airloom.plans.summary import air_quality_summary, anomaly_summary, compare_summary
from airloom.plans.trend import trend
from airloom.session import written
from helpers import at, city_frame, reading_frame, seed_cities, seed_readings

AS_OF = "2026-02-21T03:00:00Z"


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_spike_is_a_high_anomaly(spark):
    found = anomalies(seed_readings(spark), seed_cities(spark), as_of=AS_OF).collect()
    spike = [r for r in found if r["timestamp"].strftime("%Y-%m-%dT%H") == "2026-02-19T22"]
    assert len(spike) == 1 and spike[0]["severity"] == "high" and spike[0]["value"] == 71.5
    assert spike[0]["total_readings_analysed"] == 60


def test_baseline_needs_twenty_four_rows(spark):
    readings = seed_readings(spark)
    late = readings.where(F.col("timestamp") >= F.lit("2026-02-19T05:00:00Z").cast("timestamp"))
    assert anomalies(late, seed_cities(spark), as_of=AS_OF).where("value = 71.5").count() == 0


def test_warm_up_rows_are_used_but_not_reported(spark):
    start = at("2026-02-01")
    rows = [("derby", "pm25", 10.0 + (i % 3), start + timedelta(hours=i)) for i in range(24 * 14)]
    rows[24 * 3] = ("derby", "pm25", 90.0, start + timedelta(days=3))
    rows[24 * 7 + 1] = ("derby", "pm25", 95.0, start + timedelta(days=7, hours=1))
    found = anomalies(reading_frame(spark, rows), seed_cities(spark), as_of="2026-02-15", days=7, sort=True).collect()
    assert [r["value"] for r in found] == [95.0]
    assert found[0]["total_readings_analysed"] == 24 * 7


def test_constant_series_has_no_anomaly(spark):
    rows = [("derby", "pm25", 0.1, at("2026-02-19") + timedelta(hours=i)) for i in range(40)]
    rows.append(("derby", "pm25", 9.0, at("2026-02-21T00:00:00")))
    readings = reading_frame(spark, rows)
    assert anomalies(readings, seed_cities(spark), as_of=AS_OF).count() == 0
    totals = anomaly_totals(readings, seed_cities(spark), as_of=AS_OF).first()
    assert (totals["total_readings_analysed"], totals["anomalies"]) == (41, 0)


def test_argument_limits(spark):
    readings, cities = seed_readings(spark), seed_cities(spark)
    for call in (
        lambda: anomalies(readings, cities, sensitivity=0.5), lambda: anomalies(readings, cities, days=3),
        lambda: trend(readings, cities, days=0), lambda: trend(readings, cities, interval="year"),
        lambda: trend(readings, cities, keep_empty=True), lambda: compare(readings, cities, city_ids=["derby"]),
        lambda: ranking(readings, cities, limit=101), lambda: correlation(readings, cities, "pm25", "pm25"),
        lambda: readings_range(readings, start="2026-02-20", end="2026-02-19"),
        lambda: readings_page(readings, limit=0),
    ):
        with pytest.raises(ValueError):
            call()


def brute_force(series, frame):
    result = {}
    for key, rows in series.items():
        values = [v for _, v in sorted(rows)]
        for i, (moment, _) in enumerate(sorted(rows)):
            before = values[max(0, i - frame):i]
            result[(*key, moment)] = (
                len(before), statistics.fmean(before) if before else None,
                statistics.stdev(before) if len(before) > 1 else None)
    return result


def test_sliced_series_have_exact_baselines(spark):
    """Bursts, gaps and slices shorter than the frame give the same baselines as one pass per series."""
    rng = random.Random(3)
    series = {("a", "pm25"): [], ("b", "pm25"): [], ("c", "no2"): []}
    moment = at("2026-01-01")
    for i in range(900):
        moment += timedelta(seconds=1 if i % 300 < 250 else rng.randrange(1, 400_000))
        series[("a", "pm25")].append((moment, round(rng.uniform(0, 50), 2)))
    for i in range(130):
        series[("b", "pm25")].append((at("2026-01-01") + timedelta(hours=i), float(i % 7)))
    for i in range(20):
        series[("c", "no2")].append((at("2026-01-01") + timedelta(hours=i), float(i)))
    df = reading_frame(spark, [(*k, v, t) for k, rows in series.items() for t, v in rows])
    expected = brute_force(series, 30)
    for frames in (1, 2, 7, 300):
        got = rolling_baseline(df, frame_rows=30, block_frames=frames).collect()
        assert len(got) == len(expected)
        for r in got:
            size, mean, deviation = expected[(r["city_id"], r["parameter"], r["timestamp"].replace(tzinfo=at("2026-01-01").tzinfo))]
            assert r["window_size"] == size
            for measured, wanted in ((r["rolling_avg"], mean), (r["rolling_stddev"], deviation)):
                assert (measured is None) == (wanted is None)
                assert wanted is None or math.isclose(measured, wanted, rel_tol=1e-9, abs_tol=1e-9)


def test_no_task_grows_with_a_burst_or_a_stray_timestamp(spark, monkeypatch):
    """A third of all rows in one minute of one series, and one reading of it fifty years earlier."""
    start = at("2026-01-01")
    rows = [("hot", "pm25", float(i % 50), start + timedelta(milliseconds=20 * i)) for i in range(3_000)]
    rows += [("hot", "pm25", 1.0, at("1976-01-01"))]
    rows += [(f"c{i % 60}", "pm25", float(i % 9), start + timedelta(hours=i)) for i in range(6_000)]
    df = spark.createDataFrame(rows, "city_id string, parameter string, value double, timestamp timestamp")
    kept = []
    monkeypatch.setattr(positions, "written", lambda rows, name: kept.append(written(rows, name)) or kept[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins slices of so few rows
    try:
        placed = placed_rows(df)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    slices = [r["n"] for r in kept[0].groupBy(positions.SLICE).agg(F.count("*").alias("n")).collect()]
    assert max(slices) < 4 * sum(slices) / 8  # of eight range partitions
    scored = framed(placed, frame_rows=20, block_frames=5)
    assert scored.columns == df.columns + ["rolling_avg", "rolling_stddev", "window_size"] and scored.count() == 9_001
    assert scored.where("city_id = 'hot' and window_size < 20").count() == 20
    own = F.floor(F.col(PLACE) / 100)
    held = placed.groupBy("city_id", own.alias("block")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert held == 100  # and 20 rows that lead in: what one window ever holds


def test_equal_values_have_no_spread_and_nulls_count_as_rows(spark):
    start = at("2026-01-01")
    values = [0.1] * 40 + [None] * 5 + [0.3] * 10
    df = spark.createDataFrame([("c", "p", v, start + timedelta(hours=i)) for i, v in enumerate(values)],
                               "city_id string, parameter string, value double, timestamp timestamp")
    got = {r["timestamp"]: r for r in rolling_baseline(df, frame_rows=6, block_frames=2).collect()}
    by_hour = [got[(start + timedelta(hours=i)).replace(tzinfo=None)] for i in range(55)]
    assert all(r["rolling_stddev"] == 0 and r["rolling_avg"] == 0.1 and r["window_size"] == 6 for r in by_hour[6:41])
    assert by_hour[0]["window_size"] == 0 and by_hour[0]["rolling_avg"] is None and by_hour[1]["rolling_stddev"] is None
    assert by_hour[45]["window_size"] == 6 and by_hour[45]["rolling_avg"] == 0.1 and by_hour[45]["rolling_stddev"] is None
    assert math.isclose(by_hour[47]["rolling_avg"], 0.3) and by_hour[47]["rolling_stddev"] == 0


def test_trend_counts_add_up_and_weeks_are_iso(spark):
    readings, cities = seed_readings(spark), seed_cities(spark)
    for interval, buckets in (("hour", 60), ("day", 3), ("weekly", 1)):
        got = trend(readings, cities, as_of=AS_OF, interval=interval).collect()
        assert len(got) == buckets
        assert sum(r["reading_count"] for r in got) == 60 == got[0]["total_readings"]
    empty = trend(readings, cities, as_of=AS_OF, parameters=["pm25"], city_ids=["leeds"], keep_empty=True).first()
    assert empty["period"] is None and empty["total_readings"] == 0 and empty["unit"] == "µg/m³"


def test_trend_ignores_inactive_cities_and_keeps_future_rows(spark):
    cities = city_frame(spark, ("derby", "Derby", "UK", "GB", True), ("old", "Old", "UK", "GB", False))
    rows = [("derby", "pm25", 1.0, at("2026-02-25")), ("old", "pm25", 2.0, at("2026-02-20"))]
    got = trend(reading_frame(spark, rows), cities, as_of=AS_OF)
    assert rows_of(got, "city_id", "avg") == [("derby", 1.0)]
    assert trend(reading_frame(spark, rows), cities, as_of=AS_OF, until=at("2026-02-21")).count() == 0


def test_compare_ranks_rounded_averages(spark):
    cities = city_frame(spark, *[(c, c.upper(), "X", "XX", c != "d") for c in "abcde"])
    now, before = at("2026-02-20"), at("2026-02-10")
    rows = [("a", "pm25", 10.00001, now), ("b", "pm25", 10.00002, now), ("c", "pm25", 12.0, now),
            ("d", "pm25", 9.0, now), ("a", "pm25", 8.0, before), ("b", "pm25", 0.0, before), ("e", "pm25", 1.0, before)]
    got = compare(reading_frame(spark, rows), cities, as_of=AS_OF)
    assert rows_of(got, "city_id", "rank", "pct_change_vs_prev_period") == [
        ("d", 1, None), ("a", 2, 25.0), ("b", 2, None), ("c", 4, None)]
    chosen = spark.createDataFrame([("a",), ("c",)], "city_id string")
    assert rows_of(compare(reading_frame(spark, rows), cities, as_of=AS_OF, city_set=chosen), "city_id", "rank") == [
        ("a", 1), ("c", 2)]


def test_ranking_ranks_unrounded_averages_of_active_cities(spark):
    cities = city_frame(spark, ("a", "A", "X", "XX", True), ("b", "B", "X", "XX", True), ("c", "C", "Y", "YY", True),
                        ("d", "D", "X", "XX", False), ("e", "E", "X", "XX", True))
    rows = []
    for city, value, count in (("a", 10.00002, 10), ("b", 10.00001, 10), ("c", 9.0, 12), ("d", 1.0, 20), ("e", 1.0, 9)):
        rows += [(city, "pm25", value, at("2026-02-20") + timedelta(minutes=i)) for i in range(count)]
    readings = reading_frame(spark, rows)
    got = ranking(readings, cities, as_of=AS_OF)
    assert rows_of(got, "city_id", "rank", "reading_count") == [("c", 1, 12), ("b", 2, 10), ("a", 3, 10)]
    assert rows_of(ranking(readings, cities, as_of=AS_OF, country="xx"), "city_id", "country") == [("b", "XX"), ("a", "XX")]
    assert rows_of(ranking(readings, cities, as_of=AS_OF, limit=2), "city_id") == [("c",), ("b",)]
    assert ranking(readings, cities, as_of=AS_OF, limit=None, min_readings=1).count() == 4


def test_correlation_edge_cases(spark):
    cities = city_frame(spark, *[(c, c, "X", "XX", True) for c in "abcd"])
    rows = []
    for i in range(5):
        moment = at("2026-02-20") + timedelta(hours=i)
        rows += [("a", "pm25", float(i), moment), ("a", "temperature", -2.0 * i, moment),
                 ("b", "pm25", 3.0, moment), ("b", "temperature", float(i), moment)]
    rows += [("c", "pm25", 1.0, at("2026-02-20")), ("c", "temperature", 1.0, at("2026-02-20"))]
    got = {r["city_id"]: r for r in correlation(reading_frame(spark, rows), cities, "pm25", "temperature", as_of=AS_OF).collect()}
    assert (got["a"]["pearson_r"], got["a"]["interpretation"], got["a"]["direction"]) == (-1.0, "very_strong", "negative")
    assert (got["b"]["pearson_r"], got["b"]["sample_size"], got["b"]["interpretation"]) == (None, 5, "negligible")
    assert (got["c"]["pearson_r"], got["c"]["sample_size"]) == (None, 1)
    assert (got["d"]["pearson_r"], got["d"]["sample_size"], got["d"]["direction"]) == (None, 0, None)
    both = correlations(reading_frame(spark, rows), cities, [("pm25", "temperature"), ("temperature", "pm25")],
                        as_of=AS_OF, city_ids=["a"])
    assert sorted(rows_of(both, "param1", "pearson_r")) == [("pm25", -1.0), ("temperature", -1.0)]


def test_health_tolerates_one_missed_cycle(spark):
    rows = [("derby", "pm25", 1.0, at("2026-02-20T10:00:00"))]
    readings = reading_frame(spark, rows)
    fresh, stale = (health(readings, as_of=t).first() for t in ("2026-02-20T12:00:00Z", "2026-02-20T12:00:01Z"))
    assert (fresh["status"], fresh["staleness_minutes"]) == ("healthy", 120.0)
    assert stale["status"] == "degraded"
    nothing = health(readings.where("1 = 0"), as_of=AS_OF).first()
    assert (nothing["status"], nothing["last_ingestion_at"]) == ("healthy", None)
    by_city = {r["city_id"]: r["status"] for r in freshness(readings, seed_cities(spark), as_of="2026-02-20T11:00:00Z").collect()}
    assert by_city == {"derby": "healthy", "leeds": "degraded"}


def test_range_lookup_is_closed_and_flag_aware(spark):
    rows = [("derby", "pm25", 1.0, at("2026-02-20T00:00:00")), ("derby", "pm25", 999.0, at("2026-02-20T01:00:00"), "suspect"),
            ("derby", "pm25", None, at("2026-02-20T02:00:00")), ("derby", "pm25", 4.0, at("2026-02-20T03:00:00"))]
    readings = reading_frame(spark, rows)
    span = {"start": "2026-02-20T00:00:00Z", "end": "2026-02-20T03:00:00Z"}
    assert sorted(rows_of(readings_range(readings, **span), "value")) == [(1.0,), (4.0,)]
    assert readings_range(readings, include_suspect=True, **span).count() == 3
    assert rows_of(readings_page(readings_range(readings, **span), skip=1, limit=1), "value") == [(4.0,)]
    assert changed_since(readings, at("2026-02-20T01:00:00")).count() == 2


def test_summaries(spark):
    readings, cities = seed_readings(spark), seed_cities(spark)
    row = air_quality_summary(readings, cities, as_of=AS_OF).first()
    assert (row["city_id"], row["max"], row["aqi_category"], row["reading_count"]) == ("derby", 71.5, "moderate", 60)
    by_city = {r["city_id"]: r for r in anomaly_summary(readings, cities, as_of=AS_OF).collect()}
    assert by_city["derby"]["high"] >= 1 and by_city["derby"]["top_anomalies"][0]["value"] == 71.5
    assert by_city["leeds"]["total"] == 0 and by_city["leeds"]["top_anomalies"] == []
    requests = spark.createDataFrame([(1, "DERBY"), (2, "Atlantis")], "request_seq long, requested_name string")
    assert rows_of(compare_summary(readings, cities, requests, as_of=AS_OF), "city_id", "rank", "trend") == [
        ("derby", 1, "n/a")]


def test_documents_nest_rows_in_order(spark):
    rows = trend(seed_readings(spark), seed_cities(spark), as_of=AS_OF, sort=False)
    document = to_documents(rows, ["city_id", "parameter"], ["period", "reading_count"], "data").first()["document"]
    assert document.index("2026-02-18") < document.index("2026-02-19") < document.index("2026-02-20")


def km(a, b):
    (lat1, lon1), (lat2, lon2) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * math.asin(math.sqrt(min(1.0, h)))


def test_nearest_stations_match_brute_force(spark):
    rng = random.Random(11)
    centres = {"mid": (51.5, -0.1), "dateline": (-17.0, 179.98), "pole": (89.95, 10.0), "south": (-89.9, -170.0),
               "equator": (0.0, 0.0), "alone": (30.0, 100.0)}
    stations = {}
    for name, (lat, lon) in centres.items():
        for i in range(0 if name == "alone" else 60):
            d_lat = rng.gauss(0, 0.15)
            d_lon = rng.gauss(0, 0.15) / max(0.002, math.cos(math.radians(lat)))
            place = (max(-90.0, min(90.0, lat + d_lat)), (lon + d_lon + 180) % 360 - 180)
            stations[len(stations)] = place
    for _ in range(40):
        stations[len(stations)] = (51.51, -0.11)
    cities = spark.createDataFrame([(n, *p) for n, p in centres.items()], "city_id string, latitude double, longitude double")
    frame = spark.createDataFrame([(i, *p) for i, p in stations.items()], "station_id long, latitude double, longitude double")
    got = {}
    for r in nearest_stations(cities, frame).orderBy("city_id", "position").collect():
        got.setdefault(r["city_id"], []).append(r["station_id"])
    for name, centre in centres.items():
        ranked = sorted((round(km(centre, p), 9), i) for i, p in stations.items() if km(centre, p) <= 25)[:5]
        assert got.get(name, []) == [i for _, i in ranked]
