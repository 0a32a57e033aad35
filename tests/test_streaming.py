import json
import random
from datetime import timedelta

from pyspark.sql import functions as F

from airloom.functions.numeric import round_half_up
from airloom.operators.rolling import rolling_baseline
from airloom.operators.upsert import flag_readings
from airloom.schemas import READING_KEY, STAGED_READINGS
from airloom.plans.trend import trend
from airloom.session import written
from airloom.sources import landed, tables
from airloom.streaming import baseline
from airloom.streaming.baseline import current_scores, read_scores, score_writer
from airloom.streaming.ingest import cycle_stream, document_stream, read_cycles, upsert_stream
from airloom.streaming.trend import read_trend, stream_trend, trend_writer
from driver_queries.spark_side import _deliver_events
from helpers import NOON, at, city_frame, staged_frame

FIRST = at("2026-03-01")


def arrive(spark, folder, rows):
    staged_frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def arriving(spark, folder):
    return spark.readStream.schema(STAGED_READINGS).option("maxFilesPerTrigger", 1).parquet(folder)


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_stream_upsert_keeps_the_last_correction_and_survives_replays(spark, tmp_path):
    source, table, reports = str(tmp_path / "in"), str(tmp_path / "table"), []

    def go(checkpoint):
        run(upsert_stream(arriving(spark, source), table, str(tmp_path / checkpoint), as_of=FIRST,
                          report=lambda i, counts: reports.append(counts)))
        return {r["timestamp"].hour: r["value"] for r in tables.read_readings(spark, table).collect()}

    arrive(spark, source, [("c", "pm25", 1.0, NOON, 1), ("c", "pm25", 5.0, NOON + timedelta(hours=1), 2),
                           ("c", "pm25", 6.0, NOON + timedelta(hours=1), 3)])
    assert go("a") == {12: 1.0, 13: 6.0}
    arrive(spark, source, [("c", "pm25", 2.0, NOON, 4)])
    assert go("a") == {12: 2.0, 13: 6.0}
    arrive(spark, source, [("c", "pm25", 1.0, NOON, 5), ("c", "pm25", 7.0, NOON - timedelta(days=90, hours=3), 6)])
    assert go("a")[12] == 1.0
    assert tables.read_readings(spark, table).count() == 3
    assert [(r["readings_fetched"], r["inserted"], r["updated"]) for r in reports] == [(3, 2, 0), (1, 0, 1), (2, 1, 1)]
    before = tables.read_readings(spark, table).orderBy(*READING_KEY).drop("updated_at").collect()
    go("replay")
    assert tables.read_readings(spark, table).orderBy(*READING_KEY).drop("updated_at").collect() == before


def test_unreadable_documents_do_not_stop_the_rest(spark, tmp_path):
    folder, reports = tmp_path / "landing", []
    folder.mkdir()
    good = {"city_id": "c", "fetched_at": "2026-02-20T12:00:00Z", "hourly": {
        "time": ["2026-02-20T10:00"], "temperature_2m": [5.0]}, "hourly_units": {"temperature_2m": "°C"}}
    (folder / "a.json").write_text(json.dumps(good) + "\n{\"city_id\": \n" + json.dumps({**good, "city_id": "d"}) + "\n")
    run(document_stream(landed.read_weather(spark, str(folder), streaming=True), landed.parse_weather, str(tmp_path / "t"),
                        str(tmp_path / "bad"), str(tmp_path / "cp"), as_of=FIRST,
                        report=lambda i, counts: reports.append(counts)))
    assert {r["city_id"] for r in tables.read_readings(spark, str(tmp_path / "t")).collect()} == {"c", "d"}
    assert [r["value"] for r in spark.read.text(str(tmp_path / "bad")).collect()] == ["{\"city_id\": "]
    assert reports[0]["documents_quarantined"] == 1 and reports[0]["inserted"] == 2


def test_stream_trend_counts_repeats_once_and_closes_buckets(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("c", "pm25", float(h), at("2026-02-16") + timedelta(hours=h), h) for h in range(72)]
    arrive(spark, source, rows)
    run_trend = lambda: run(stream_trend(flag_readings(arriving(spark, source)), "day").writeStream.format("parquet")
                            .option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append"))
    run_trend()
    arrive(spark, source, [("c", "pm25", 99.0, rows[60][3], 100), ("c", "pm25", 1.0, at("2026-02-20"), 101)])
    run_trend()
    arrive(spark, source, [("c", "pm25", 1.0, at("2026-02-25"), 102)])
    run_trend()
    got = {r["period"].day: (r["reading_count"], r["max"]) for r in spark.read.parquet(out).collect()}
    assert got == {16: (24, 23.0), 17: (24, 47.0), 18: (24, 71.0), 20: (1, 1.0)}


def scores_of(rows):
    return {(r["city_id"], r["parameter"], r["timestamp"]): (r["window_size"], r["rolling_avg"], r["rolling_stddev"])
            for r in rows.collect()}


def full_scores(spark, table, frame):
    valid = tables.read_readings(spark, table).where("quality_flag = 'valid'").select(*READING_KEY, "value")
    scored = rolling_baseline(valid, frame_rows=frame)
    return scores_of(scored.select(*READING_KEY, "window_size", round_half_up(F.col("rolling_avg"), 4).alias("rolling_avg"),
                                   round_half_up(F.col("rolling_stddev"), 4).alias("rolling_stddev")))


def test_stream_scores_equal_a_full_recomputation(spark, tmp_path, monkeypatch):
    """In order, late, corrected and vanishing readings, repeated batches, and readings that came past the scores."""
    source, table, scores, tails = (str(tmp_path / n) for n in ("in", "table", "scores", "tails"))
    rng, looked_up = random.Random(5), []
    monkeypatch.setattr(baseline, "written", lambda rows, name: (name == "baseline-days" and looked_up.append(rows.count())) or
                        written(rows, name))

    def go(checkpoint="cp"):
        looked_up.clear()
        run(upsert_stream(arriving(spark, source), table, str(tmp_path / checkpoint), as_of=FIRST,
                          after=score_writer(table, scores, tails, frame_rows=6, compact_every=3)))
        current = current_scores(tables.read_readings(spark, table), read_scores(spark, scores))
        assert scores_of(current) == full_scores(spark, table, 6)
        assert current.count() == current.select(*READING_KEY).distinct().count()
        return list(looked_up)

    start = at("2026-02-01")
    value = lambda: round(rng.uniform(1, 100), 1)
    arrive(spark, source, [("c", "pm25", value(), start + timedelta(hours=6 * i), i) for i in range(40)]
           + [("d", "no2", value(), start + timedelta(days=3 * i), i) for i in range(5)])
    assert go() == [0]
    arrive(spark, source, [("c", "pm25", value(), start + timedelta(hours=6 * 40), 50), ("d", "no2", value(), at("2026-02-20"), 51),
                           ("e", "no2", value(), at("2026-02-20"), 52)])
    assert go() == [0]  # old and young series that go on in order: the table is not read
    arrive(spark, source, [("c", "pm25", value(), start + timedelta(hours=6 * 20), 60),
                           ("c", "pm25", 999.0, start + timedelta(hours=6 * 22), 61),
                           ("c", "pm25", value(), start + timedelta(hours=6 * 21 + 1), 62)])
    days = go()
    assert 0 < days[0] <= 2 + 2 + 3 + 2  # its own days, a frame before, a frame after and the tail, of eleven
    arrive(spark, source, [("d", "no2", 999.0, at("2026-02-20"), 70), ("e", "no2", 999.0, at("2026-02-20"), 71)])
    go()  # the last reading of one series is gone, and the only one of another
    arrive(spark, source, [("d", "no2", value(), at("2026-02-27"), 80), ("e", "no2", value(), at("2026-02-27"), 81)])
    assert go() == [0]
    past = flag_readings(staged_frame(spark, [("d", "no2", value(), at("2026-02-28"), 85)]))
    tables.upsert_readings(spark, past, table, FIRST)  # nobody has scored this one
    arrive(spark, source, [("d", "no2", value(), at("2026-03-01"), 90)])
    assert go()[0] > 0
    go("replay")  # all batches again


def test_stream_trend_equals_the_batch_trend(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    cities = city_frame(spark, *[(c, c, "X", "XX", True) for c in "cd"])
    start = at("2026-02-14")

    def go(checkpoint="cp"):
        for name in ("hour", "day", "week"):
            run(upsert_stream(arriving(spark, source), table, str(tmp_path / f"{checkpoint}-{name}"), as_of=FIRST,
                              after=trend_writer(table, str(tmp_path / name), name, compact_every=2)))
            kept = ["city_id", "parameter", "period", "avg", "min", "max", "reading_count"]
            batch = trend(tables.read_readings(spark, table), cities, as_of="2026-03-01T00:00:00Z", interval=name, days=30)
            assert sorted(map(tuple, read_trend(spark, str(tmp_path / name)).select(*kept).collect())) == sorted(
                map(tuple, batch.select(*kept).collect()))

    arrive(spark, source, [("c", "pm25", float(h), start + timedelta(hours=h), h) for h in range(80)])
    go()
    arrive(spark, source, [("c", "pm25", 70.0, start + timedelta(hours=3), 100), ("d", "no2", 1.0, start - timedelta(days=9), 101),
                           ("c", "pm25", None, start + timedelta(hours=79), 102), ("d", "no2", 2.0, start, 103)])
    go()  # a correction, a reading weeks late, and hours that lose their only reading
    arrive(spark, source, [("d", "no2", 900.0, start, 110), ("c", "pm25", 5.0, start + timedelta(hours=79), 111)])
    go()
    go("replay")


def test_cycles_of_two_sources_isolate_failures(spark, tmp_path):
    """Two sources in one stream: failed fetches, an unreadable line, an inactive city, a later correction, a replay."""
    base, cities = str(tmp_path / "base"), city_frame(
        spark, *[(c, c.title(), "X", "XX", c != "old") for c in ("derby", "leeds", "york", "old")])
    weather, measured = tmp_path / "weather", tmp_path / "measured"
    sensors = spark.createDataFrame([("derby", "pm25", 5, "u", "s"), ("old", "pm25", 6, "u", "s")],
                                    "city_id string, parameter string, sensor_id long, sensor_unit string, station_name string")

    def forecast(city, value, fetched="2026-02-20T12:00:00Z"):
        return {"city_id": city, "fetched_at": fetched, "hourly": {"time": ["2026-02-20T10:00"], "temperature_2m": [value]},
                "hourly_units": {"temperature_2m": "°C"}}

    def reading(city, sensor, value):
        return {"city_id": city, "sensor_id": sensor, "fetched_at": "2026-02-20T12:00:00Z",
                "results": [{"value": value, "datetime": {"utc": "2026-02-20T10:00:00Z"}}]}

    def land(folder, name, *documents):
        folder.mkdir(exist_ok=True)
        (folder / name).write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in documents) + "\n")

    def go():
        run(cycle_stream({
            "weather": (landed.read_weather(spark, str(weather), streaming=True), landed.parse_weather),
            "measured": (landed.read_measurements(spark, str(measured), streaming=True), lambda d: landed.parse_measurements(d, sensors))},
            cities, base, as_of=FIRST))
        return {r["cycle"]: tuple(r)[:4] for r in read_cycles(spark, base, "reports").collect()}

    land(weather, "a.json", forecast("derby", 5.0), "{broken", {"city_id": "leeds", "error": "timeout"}, forecast("old", 1.0))
    land(measured, "a.json", reading("derby", 5, 7.0), reading("old", 6, 7.0), {"city_id": "old", "error": "gone"})
    assert go() == {0: (3, 2, 1, 2)}
    land(weather, "b.json", forecast("derby", 6.0, "2026-02-20T13:00:00Z"), forecast("leeds", 2.0))
    land(measured, "b.json", {"city_id": "york", "error": "timeout"}, "[1")
    assert go()[1] == (3, 2, 1, 2)
    stored = {(r["city_id"], r["parameter"]): r["value"] for r in tables.read_readings(spark, f"{base}/readings").collect()}
    assert stored == {("derby", "temperature"): 6.0, ("derby", "pm25"): 7.0, ("leeds", "temperature"): 2.0}
    assert sorted((r["cycle"], r["city_id"], r["error"]) for r in read_cycles(spark, base, "errors").collect()) == [
        (0, "leeds", "timeout"), (0, "old", "gone"), (1, "york", "timeout")]
    assert sorted((r["cycle"], r["source"], r["line"]) for r in read_cycles(spark, base, "quarantine").collect()) == [
        (0, "weather", "{broken"), (1, "measured", "[1")]
    stats = {(r["cycle"], r["city_id"]): (r["readings_fetched"], r["readings_inserted"], r["readings_updated"])
             for r in read_cycles(spark, base, "stats").collect()}
    assert stats == {(0, "derby"): (2, 2, 0), (0, "leeds"): (0, 0, 0), (0, "york"): (0, 0, 0),
                     (1, "derby"): (1, 0, 1), (1, "leeds"): (1, 1, 0), (1, "york"): (0, 0, 0)}


def test_events_are_delivered_in_four_batches_of_several_files(spark, tmp_path):
    batches = []
    _deliver_events(spark, "/root/testdata/sf0.1", str(tmp_path), lambda arriving: arriving.writeStream.foreachBatch(
        lambda batch, number: batches.append((number, batch.count()))).option("checkpointLocation", f"{tmp_path}/checkpoint"))
    assert [number for number, _ in batches] == [0, 1, 2, 3]
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    assert sum(rows for _, rows in batches) == events.count() + events.where("event_id % 20 = 7").count()
    assert len(list((tmp_path / "landing").glob("*.parquet"))) > 4  # one file each is one task each
