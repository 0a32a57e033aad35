import json
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from airloom.operators.constraints import constraint_violations
from airloom.operators.upsert import flag_readings, latest_per_key, merge_readings, reading_id, reprocess
from airloom.plans import ingest, lookup
from airloom.schemas import CITIES, LOCATIONS_DOC, READINGS
from airloom.session import work_folder
from airloom.sources import landed, layers, tables
from airloom.sources.landed import chosen_sensors, parse_measurements
from helpers import NOON, at, city_frame, reading_frame, seed_cities, staged_frame

FIRST, SECOND, THIRD = at("2026-02-21"), at("2026-02-22"), at("2026-02-23")


@pytest.fixture
def folder(spark, tmp_path):
    return str(tmp_path / "readings")


def stored(spark, path):
    return {(r["city_id"], r["parameter"], r["timestamp"].hour): r for r in tables.read_readings(spark, path).collect()}


def batch(spark, *rows):
    return flag_readings(staged_frame(spark, [(c, p, v, NOON + timedelta(hours=h), n) for c, p, v, h, n in rows]))


def test_upsert_inserts_corrects_and_repeats_without_effect(spark, folder):
    first = batch(spark, ("derby", "pm25", 10.0, 0, 1), ("derby", "pm25", 11.0, 1, 2), ("derby", "no2", 5.0, 0, 3))
    assert tables.upsert_readings(spark, first, folder, FIRST) == {"inserted": 3, "updated": 0}
    before = stored(spark, folder)
    assert tables.upsert_readings(spark, first, folder, SECOND) == {"inserted": 0, "updated": 0}
    assert stored(spark, folder) == before

    second = batch(spark, ("derby", "pm25", 12.0, 0, 1), ("derby", "pm25", None, 1, 2), ("paris", "pm25", 1.0, 0, 3))
    assert tables.upsert_readings(spark, second, folder, SECOND) == {"inserted": 1, "updated": 2}
    after = stored(spark, folder)
    corrected, blanked, untouched = (after["derby", "pm25", 12], after["derby", "pm25", 13], after["derby", "no2", 12])
    assert corrected["value"] == 12.0 and corrected["created_at"] == before["derby", "pm25", 12]["created_at"]
    assert corrected["updated_at"] > corrected["created_at"] and corrected["id"] == before["derby", "pm25", 12]["id"]
    assert (blanked["value"], blanked["quality_flag"]) == (None, "missing")
    assert untouched == before["derby", "no2", 12]
    assert len(after) == 4


def test_unit_or_source_alone_changes_nothing(spark, folder):
    first = batch(spark, ("derby", "pm25", 10.0, 0, 1))
    tables.upsert_readings(spark, first, folder, FIRST)
    renamed = first.withColumns({"unit": F.lit("other"), "source": F.lit("other")})
    assert tables.upsert_readings(spark, renamed, folder, SECOND)["updated"] == 0
    assert stored(spark, folder)["derby", "pm25", 12]["unit"] == "u"


def test_last_arrival_of_a_batch_wins(spark):
    rows = batch(spark, ("derby", "pm25", 1.0, 0, 1), ("derby", "pm25", 3.0, 0, 9), ("derby", "pm25", 2.0, 0, 5))
    assert [r["value"] for r in latest_per_key(rows).collect()] == [3.0]
    empty = spark.createDataFrame([], READINGS)
    merged = merge_readings(empty, rows, FIRST).collect()
    assert [(r["value"], r["action"]) for r in merged] == [(3.0, "inserted")]


def test_ids_follow_from_the_key(spark):
    rows = spark.createDataFrame([("a", "b", NOON), ("a", "b", NOON), ("a", "c", NOON)], "c string, p string, t timestamp")
    ids = [r[0] for r in rows.select(reading_id(F.col("c"), F.col("p"), F.col("t"))).collect()]
    assert ids[0] == ids[1] != ids[2]


def files_of(path):
    return sorted(str(f.relative_to(path)) for f in Path(path).glob("data/**/*.parquet"))


def test_small_batches_add_files_and_rewrite_none(spark, folder):
    tables.upsert_readings(spark, batch(spark, *[("derby", "pm25", 1.0, 24 * d, d) for d in range(3)]), folder, FIRST)
    old = files_of(folder)
    stamps = {f: (Path(folder) / f).stat().st_mtime_ns for f in old}
    assert len(old) == 3
    tables.upsert_readings(spark, batch(spark, ("derby", "pm25", 2.0, 0, 1), ("paris", "pm25", 3.0, 0, 2)), folder, SECOND)
    new = files_of(folder)
    assert len(new) == 4 and all((Path(folder) / f).stat().st_mtime_ns == stamps[f] for f in old)
    assert {k: r["value"] for k, r in stored(spark, folder).items() if k[0] == "paris"} == {("paris", "pm25", 12): 3.0}
    assert tables.read_readings(spark, folder).count() == 4
    tables.upsert_readings(spark, batch(spark, ("derby", "pm25", 2.0, 0, 1)), folder, THIRD)
    assert files_of(folder) == new  # a replay commits nothing


@pytest.mark.parametrize("moment", ["data", "log"])
def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, folder, monkeypatch, moment):
    tables.upsert_readings(spark, batch(spark, ("derby", "pm25", 1.0, 0, 1)), folder, FIRST)
    before = stored(spark, folder)
    corrected = batch(spark, ("derby", "pm25", 9.0, 0, 1), ("derby", "pm25", 5.0, 1, 2))
    finish = layers.write_log

    def dies(told, path, name):
        if moment == "log":  # the entry's files are there, the mark that its job has finished is not
            finish(told, path, name)
            (Path(path) / "log" / name / "_SUCCESS").unlink()
        raise OSError("lost")

    monkeypatch.setattr(layers, "write_log", dies)
    with pytest.raises(OSError):
        tables.upsert_readings(spark, corrected, folder, SECOND)
    assert len(files_of(folder)) > 1 and stored(spark, folder) == before
    monkeypatch.setattr(layers, "write_log", finish)
    assert tables.upsert_readings(spark, corrected, folder, THIRD) == {"inserted": 1, "updated": 1}
    after = stored(spark, folder)
    assert after["derby", "pm25", 12]["value"] == 9.0 and len(after) == 2
    assert after["derby", "pm25", 12]["updated_at"].day == THIRD.day


def test_compaction_roll_up_and_expiry_keep_every_row(spark, folder):
    for i in range(4):
        rows = [("derby", "pm25", float(i), 0, 1), (f"c{i}", "pm25", 1.0, 1, 2), ("derby", "no2", 5.0, 24 * i, 3)]
        tables.upsert_readings(spark, batch(spark, *rows), folder, FIRST + timedelta(hours=i))
    def content():
        return sorted(map(tuple, tables.read_readings(spark, folder).collect()))

    def counts():
        return {(r["city_id"], r["parameter"]): r["n"] for r in tables.reading_log(spark, folder).groupBy("city_id", "parameter").agg(
            F.sum("valid").alias("n")).collect()}

    rows, valid, several = content(), counts(), len(files_of(folder))
    assert len(rows) == 9 and valid[("derby", "no2")] == 4 and valid[("derby", "pm25")] == 1
    assert tables.compact_readings(spark, folder, most_layers=3) == 1 and tables.compact_readings(spark, folder, most_layers=3) == 0
    assert content() == rows and counts() == valid and len(files_of(folder)) > several
    layers.roll_up(spark, folder)
    assert content() == rows and counts() == valid and len(layers.commits(spark, folder)) == 1
    assert layers.expire(spark, folder, tables.READINGS_LAYOUT) == 4
    assert content() == rows and layers.expire(spark, folder, tables.READINGS_LAYOUT) == 0
    tables.upsert_readings(spark, batch(spark, ("derby", "pm25", 77.0, 0, 1)), folder, THIRD)
    assert stored(spark, folder)["derby", "pm25", 12]["value"] == 77.0 and len(content()) == 9


def test_plain_partition_folders_are_taken_in(spark, folder):
    rows = reading_frame(spark, [("derby", "pm25", 1.0, NOON), ("paris", "pm25", 2.0, NOON)])
    rows.write.partitionBy("parameter", "reading_date").parquet(folder)
    assert len(stored(spark, folder)) == 2
    tables.upsert_readings(spark, batch(spark, ("derby", "pm25", 8.0, 0, 1)), folder, SECOND)
    assert {k[0]: r["value"] for k, r in stored(spark, folder).items()} == {"derby": 8.0, "paris": 2.0}


def test_two_writers_at_once_are_an_error(spark, folder, monkeypatch):
    tables.upsert_readings(spark, batch(spark, ("derby", "pm25", 1.0, 0, 1)), folder, FIRST)
    finish = layers.write_log

    def overtaken(told, path, name):
        finish(told, path, name[:10] + "00000000")
        finish(told, path, name)

    monkeypatch.setattr(layers, "write_log", overtaken)
    with pytest.raises(RuntimeError, match="another writer"):
        tables.upsert_readings(spark, batch(spark, ("derby", "pm25", 2.0, 0, 1)), folder, SECOND)


def test_freshness_and_changes_come_from_the_log(spark, folder):
    cities = seed_cities(spark)
    tables.upsert_readings(spark, batch(spark, *[("derby", "pm25", 1.0, 24 * d, d) for d in range(4)]), folder, FIRST)
    tables.upsert_readings(spark, batch(spark, ("derby", "pm25", 3.0, 24, 1), ("leeds", "no2", None, 2, 2)), folder, SECOND)
    log, table = tables.reading_log(spark, folder), tables.read_readings(spark, folder)
    assert lookup.health(log, as_of=THIRD).collect() == lookup.health(table, as_of=THIRD).collect()
    assert sorted(lookup.freshness(log, cities, as_of=THIRD).collect()) == sorted(lookup.freshness(table, cities, as_of=THIRD).collect())
    read = [f for f in lookup.freshness(log, cities, as_of=THIRD).inputFiles() if folder in f]
    assert read and all("/log/" in f for f in read)
    changed = tables.changed_readings(spark, folder, FIRST)
    assert sorted((r["city_id"], r["value"]) for r in changed.collect()) == [("derby", 3.0), ("leeds", None)]
    assert "PartitionFilters" in changed._jdf.queryExecution().toString() and changed.count() == 2
    assert tables.changed_readings(spark, folder, THIRD).count() == 0
    nothing = tables.reading_log(spark, folder + "-never")
    assert lookup.health(nothing, as_of=THIRD).first()["last_ingestion_at"] is None


def test_touched_partitions_are_pruned_and_exact(spark, folder):
    tables.upsert_readings(spark, batch(spark, *[("derby", "pm25", 1.0, 24 * d, d) for d in range(5)]), folder, FIRST)
    some = batch(spark, ("x", "pm25", 1.0, 24, 1), ("x", "pm25", 1.0, 72, 1)).withColumn(
        "reading_date", F.to_date("timestamp"))
    table = tables.read_readings(spark, folder)
    picked = tables.touched_partitions(table, some, ["parameter", "reading_date"])
    assert picked.count() == 2
    filters = picked._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert "reading_date" in filters.split("]")[0]
    assert tables.touched_partitions(table, some.where("1 = 0"), ["parameter", "reading_date"]).count() == 0


def test_time_bounds_prune_partitions(spark, folder):
    from airloom.operators.filters import usable_readings

    tables.upsert_readings(spark, batch(spark, *[("derby", "pm25", 1.0, 24 * d, d) for d in range(5)]), folder, FIRST)
    recent = usable_readings(tables.read_readings(spark, folder), since=at("2026-02-23"), parameters=["pm25"])
    plan = recent._jdf.queryExecution().toString()
    partition_filters = plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "reading_date" in partition_filters and "parameter" in partition_filters
    assert recent.count() == 2


def test_reprocess_starts_from_the_raw_values(spark):
    rows = reading_frame(spark, [("c", "wind_speed", 99.0, NOON), ("c", "pm25", 1.0, NOON)]).withColumns({
        "raw_value": F.when(F.col("parameter") == "wind_speed", 36.0).otherwise(700.0),
        "raw_unit": F.when(F.col("parameter") == "wind_speed", "km/h").otherwise("µg/m³")})
    got = {r["parameter"]: (r["value"], r["unit"], r["quality_flag"]) for r in reprocess(rows).collect()}
    assert got == {"wind_speed": (10.0, "m/s", "valid"), "pm25": (700.0, "µg/m³", "suspect")}


def test_constraint_violations(spark):
    rows = reading_frame(spark, [
        ("derby", "pm25", 1.0, NOON), ("derby", "pm25", 2.0, NOON), ("derby", "no2", 1.0, NOON, "odd"),
        ("atlantis", "o3", 1.0, NOON), ("derby", "co", 1.0, NOON, "missing")])
    got = sorted((r["rule"], r["city_id"], r["parameter"], r["violating_rows"])
                 for r in constraint_violations(rows, seed_cities(spark)).collect())
    assert got == [("city_reference", "atlantis", "o3", 1), ("missing_means_null", "derby", "co", 1),
                   ("quality_flag_domain", "derby", "no2", 1), ("unique_key", "derby", "pm25", 2)]


def test_tables_are_declared_once(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS declared")
    for _ in range(2):
        tables.create_tables(spark, str(tmp_path / "base"), "declared")
    assert {r["tableName"] for r in spark.sql("SHOW TABLES IN declared").collect() if not r["isTemporary"]} >= {
        "readings", "cities", "insight_cache"}
    assert spark.table("declared.readings").count() == 0
    spark.sql("DROP DATABASE declared CASCADE")


def test_city_copies_are_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "cities")
    tables.write_cities(seed_cities(spark), path)
    assert tables.read_cities(spark, path).schema.fieldNames() == CITIES.fieldNames()
    assert tables.read_cities(spark, path).count() == 2
    with pytest.raises(Exception):
        tables.write_cities(seed_cities(spark), path)


def test_work_folders_lie_in_the_shared_folder(spark):
    one, two = work_folder(spark, "x"), work_folder(spark, "x")
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert one.startswith(base) and one != two


def test_bound_sql(spark):
    tables.register_views(reading_frame(spark, [("derby", "pm25", 1.0, NOON), ("paris", "pm25", 2.0, NOON)]), seed_cities(spark))
    got = tables.run_sql(spark, "SELECT value FROM readings WHERE city_id = :city", {"city": "paris"})
    assert [r["value"] for r in got.collect()] == [2.0]


# Landed documents

def lines(path, *documents):
    path.mkdir(parents=True, exist_ok=True)
    text = [d if isinstance(d, str) else json.dumps(d) for d in documents]
    (path / "part.json").write_text("\n".join(text) + "\n")
    return str(path)


WEATHER = {
    "city_id": "derby", "fetched_at": "2026-02-20T12:00:00Z",
    "hourly": {"time": ["2026-02-20T10:00", "bad", "2026-02-20T12:00", "2026-02-20T13:00"],
               "temperature_2m": [5.0, 6.0, None], "wind_speed_10m": [18.0, 1.0, 36.0, 0.09]},
    "hourly_units": {"temperature_2m": "°C", "wind_speed_10m": "km/h"},
}


def test_weather_documents(spark, tmp_path):
    documents = landed.read_weather(spark, lines(tmp_path / "w", WEATHER))
    got = sorted((r["parameter"], r["timestamp"].hour, r["value"], r["unit"], r["raw_value"], r["raw_unit"])
                 for r in landed.parse_weather(documents).collect())
    assert got == [("temperature", 10, 5.0, "°C", 5.0, "°C"), ("temperature", 12, None, "°C", None, "°C"),
                   ("wind_speed", 10, 5.0, "m/s", 18.0, "km/h"), ("wind_speed", 12, 10.0, "m/s", 36.0, "km/h"),
                   ("wind_speed", 13, round(0.09 / 3.6, 2), "m/s", 0.09, "km/h")]
    late = landed.parse_weather(documents, at("2026-02-21T13:30:00"))
    assert late.count() == 1 and late.first()["timestamp"].hour == 13


def station(name, *sensors):
    return {"name": name, "sensors": [{"id": i, "parameter": {"name": p, "units": u}} for i, p, u in sensors]}


def test_air_quality_documents(spark, tmp_path):
    old = {"city_id": "derby", "fetched_at": "2026-02-19T00:00:00Z", "results": [station("gone", (99, "pm25", "x"))]}
    new = {"city_id": "derby", "fetched_at": "2026-02-20T00:00:00Z", "results": [
        station("near", (1, "PM25", "µg/m³"), (2, "radon", "Bq")), station("far", (3, "pm25", "µg/m³"), (4, "o3", None))]}
    sensors = landed.chosen_sensors(landed.read_locations(spark, lines(tmp_path / "l", old, new)))
    assert sorted((r["parameter"], r["sensor_id"], r["sensor_unit"], r["station_name"]) for r in sensors.collect()) == [
        ("o3", 4, "µg/m³", "far"), ("pm25", 1, "µg/m³", "near")]

    def doc(sensor, *results):
        return {"city_id": "derby", "sensor_id": sensor, "fetched_at": "2026-02-20T12:00:00Z", "results": list(results)}

    documents = landed.read_measurements(spark, lines(
        tmp_path / "m",
        doc(1, {"value": 7.5, "datetime": {"utc": "2026-02-20T10:00:00Z"}},
            {"value": 8.5, "datetime": {"utc": ""}, "period": {"datetimeFrom": {"utc": "2026-02-20T11:00:00Z"}}},
            {"value": None, "datetime": {"utc": "2026-02-20T12:00:00Z"}}, {"value": 1.0, "datetime": {"utc": "soon"}},
            {"value": 2.0}),
        doc(3, {"value": 1.0, "datetime": {"utc": "2026-02-20T10:00:00Z"}}),
        doc(4, {"value": 3.0, "datetime": {"utc": "2026-02-18T10:00:00Z"}})))
    got = sorted((r["parameter"], r["timestamp"].day, r["timestamp"].hour, r["value"], r["unit"], r["source"])
                 for r in landed.parse_measurements(documents, sensors).collect())
    assert got == [("o3", 18, 10, 3.0, "µg/m³", "openaq"), ("pm25", 20, 10, 7.5, "µg/m³", "openaq"),
                   ("pm25", 20, 11, 8.5, "µg/m³", "openaq"), ("pm25", 20, 12, None, "µg/m³", "openaq")]
    assert landed.parse_measurements(documents, sensors, NOON).count() == 3


def test_unreadable_lines_are_kept_apart(spark, tmp_path):
    documents = landed.read_documents(spark, lines(tmp_path / "x", {"city_id": "a", "error": "timeout"}, "{broken"),
                                      LOCATIONS_DOC).persist()
    assert documents.where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record").collect()[0][0] == "{broken"
    assert [tuple(r) for r in landed.fetch_errors(documents).collect()] == [("a", "timeout")]


def test_ingest_cycle(spark, tmp_path, folder):
    cities = city_frame(spark, ("derby", "Derby", "UK", "GB", True), ("paris", "Paris", "FR", "FR", True),
                        ("rome", "Rome", "IT", "IT", True), ("old", "Old", "UK", "GB", False))
    weather = landed.parse_weather(landed.read_weather(spark, lines(tmp_path / "w", WEATHER, {**WEATHER, "city_id": "old"})))
    extra = staged_frame(spark, [("paris", "pm25", 900.0, NOON, 1)])
    staged = ingest.stage_readings(cities, weather, extra)
    stats = {r["city_id"]: r for r in ingest.ingest_stats(staged, cities).collect()}
    assert set(stats) == {"derby", "paris", "rome"}
    assert (stats["derby"]["readings_fetched"], stats["derby"]["quality_valid"], stats["derby"]["quality_missing"]) == (5, 4, 1)
    assert (stats["paris"]["quality_suspect"], stats["rome"]["readings_fetched"], stats["paris"]["readings_skipped"]) == (1, 0, 0)

    merged = merge_readings(tables.read_readings(spark, folder), staged, FIRST)
    errors = spark.createDataFrame([("rome", "timeout"), ("rome", "again"), ("old", "x")], "city_id string, error string")
    report = ingest.cycle_report(cities, ingest.merge_counts(merged), errors).first()
    assert tuple(report) == (3, 2, 1, 6)
    assert ingest.run_ingest(spark, staged, folder, FIRST) == {"inserted": 6, "updated": 0}


def test_last_place_in_a_document_wins_in_any_partitioning(spark):
    from airloom.operators.upsert import latest_per_key

    hours = ", ".join(f"(named_struct('value', {v}D, 'datetime', named_struct('utc', '2026-02-20T{h:02d}:00:00Z'), 'period', "
                      "named_struct('datetimeFrom', named_struct('utc', string(null)))))" for v in (1, 2) for h in range(10))
    documents = spark.sql(f"SELECT 'derby' AS city_id, 5L AS sensor_id, '2026-02-20T12:00:00Z' AS fetched_at, array({hours}) AS results")
    sensors = spark.createDataFrame([("derby", "pm25", 5, "µg/m³", "s")],
                                    "city_id string, parameter string, sensor_id long, sensor_unit string, station_name string")
    staged = parse_measurements(documents, sensors)
    for parts in (1, 3, 7):
        kept = latest_per_key(staged.repartition(parts)).collect()
        assert len(kept) == 10 and {r["value"] for r in kept} == {2.0}


def test_newest_location_document_is_newest_by_instant(spark):
    old, new = "2026-02-20T12:00:00+02:00", "2026-02-20T11:00:00Z"
    station = "array(named_struct('name', '{0}', 'sensors', array(named_struct('id', {1}L, 'parameter', named_struct('name', 'pm25', 'units', 'u')))))"
    documents = spark.sql(" UNION ALL ".join(
        f"SELECT 'derby' AS city_id, '{at_}' AS fetched_at, {station.format(name, number)} AS results"
        for at_, name, number in ((old, "old", 1), (new, "new", 2))))
    assert chosen_sensors(documents).first()["sensor_id"] == 2
