"""Landed documents at scale: one pass over the readings, in code that is short enough to be compiled."""

import json
import random
import re
from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from airloom.operators.upsert import counted_latest, flag_readings, insertable, latest_per_key
from airloom.schemas import ARRIVAL_PLACE, CORRUPT_COLUMN
from airloom.sources import landed, tables
from airloom.streaming.ingest import arrival_counts, document_stream, quality_counts
from helpers import NOON, at, staged_frame

LONGEST_COMPILED = 8000  # fixed value: bytes of a method beyond which the JVM interprets it for ever

DOCUMENT = {"city_id": "c", "fetched_at": "2026-02-20T12:00:00Z", "error": None, "hourly": {
    "time": ["2026-02-20T10:00", "2026-02-20T11:00"], "temperature_2m": [5.0], "relative_humidity_2m": [None, 50.0],
    "wind_speed_10m": [10.0, 900.0], "precipitation": []}, "hourly_units": {"temperature_2m": "°C", "wind_speed_10m": "km/h"}}


def lines(folder, *documents):
    folder.mkdir()
    (folder / "a.json").write_text("".join((d if isinstance(d, str) else json.dumps(d)) + "\n" for d in documents))
    return str(folder)


def test_code_that_parses_and_flags_weather_is_compiled(spark, tmp_path, capsys):
    documents = landed.read_weather(spark, lines(tmp_path / "in", DOCUMENT))
    readable = documents.where(F.col(CORRUPT_COLUMN).isNull()).drop(CORRUPT_COLUMN)
    for rows in (landed.parse_weather(readable), insertable(flag_readings(landed.parse_weather(readable)))):
        rows.explain("codegen")
        sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) < LONGEST_COMPILED


def test_counted_latest_keeps_the_rows_of_latest_per_key(spark):
    rng, values = random.Random(5), [None, float("nan"), -1.0, 3.0, 700.0]
    rows = [(rng.choice("ab"), rng.choice(["pm25", "humidity", "unknown"]), rng.choice(values), NOON + timedelta(hours=rng.randrange(3)),
             rng.randrange(3)) for _ in range(400)]
    staged = staged_frame(spark, rows).withColumn(ARRIVAL_PLACE, F.when(F.col("value") > 0, F.lit(1)).cast("long"))
    flagged = flag_readings(staged)
    for parts in (1, 5):
        newest = counted_latest(flagged.repartition(parts))
        kept = latest_per_key(flagged.repartition(parts))
        assert newest.count() == kept.count() == 18
        same = newest.select(*kept.columns)
        assert sorted(map(str, same.collect())) == sorted(map(str, kept.collect()))
        assert arrival_counts(newest) == quality_counts(flagged)
    assert arrival_counts(counted_latest(flagged.where("false"))) == quality_counts(flagged.where("false"))


def test_document_stream_reduces_readings_before_it_keeps_them(spark, tmp_path, monkeypatch):
    later = {**DOCUMENT, "fetched_at": "2026-02-20T13:00:00Z"}
    later["hourly"] = {**DOCUMENT["hourly"], "temperature_2m": [6.0, None]}
    source, held, reports = lines(tmp_path / "in", later, DOCUMENT, "{\"city_id\""), [], []
    persist = DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda self, *level: held.append(self.columns) or persist(self, *level))
    for checkpoint in ("cp", "replay"):
        document_stream(
            landed.read_weather(spark, source, streaming=True), landed.parse_weather, str(tmp_path / "t"), str(tmp_path / "bad"),
            str(tmp_path / checkpoint), as_of=at("2026-03-01"), report=lambda i, counts: reports.append(counts),
        ).trigger(availableNow=True).start().awaitTermination()
    stored = {(r["parameter"], r["timestamp"].hour): (r["value"], r["quality_flag"])
              for r in tables.read_readings(spark, str(tmp_path / "t")).collect()}
    assert stored == {
        ("temperature", 10): (6.0, "valid"), ("temperature", 11): (None, "missing"), ("humidity", 10): (None, "missing"),
        ("humidity", 11): (50.0, "valid"), ("wind_speed", 10): (2.78, "valid"), ("wind_speed", 11): (250.0, "suspect")}
    told = {"readings_fetched": 11, "quality_valid": 6, "quality_suspect": 2, "quality_missing": 3, "documents_quarantined": 1}
    assert reports == [{**told, "inserted": 6, "updated": 0}, {**told, "inserted": 0, "updated": 0}]
    assert held and not any("parameter" in columns for columns in held)
