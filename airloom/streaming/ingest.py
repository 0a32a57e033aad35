"""Streaming ingest: landed files to the readings table, with quarantine and batch metrics."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from airloom.operators.upsert import counted_latest, flag_readings, insertable
from airloom.plans.ingest import cycle_report, ingest_stats, stage_readings
from airloom.schemas import CORRUPT_COLUMN, MISSING, QUALITY_FLAGS, SUSPECT, VALID
from airloom.session import written
from airloom.sources.landed import fetch_errors
from airloom.sources.tables import merge_into, merged_by_city, upsert_readings


def quality_counts(staged: DataFrame) -> dict:
    flag = F.col("quality_flag")
    row = staged.agg(
        F.count(F.lit(1)).alias("readings_fetched"), F.count_if(flag == VALID).alias("quality_valid"),
        F.count_if(flag == SUSPECT).alias("quality_suspect"), F.count_if(flag == MISSING).alias("quality_missing"),
    ).first()
    return row.asDict()


def arrival_counts(newest: DataFrame) -> dict:
    """:func:`quality_counts` of the readings that :func:`counted_latest` was given."""
    row = newest.agg(*[F.coalesce(F.sum(f"arrived_{flag}"), F.lit(0)).alias(f"quality_{flag}") for flag in QUALITY_FLAGS]).first()
    return {"readings_fetched": sum(row), **row.asDict()}


def upsert_stream(staged: DataFrame, table: str, checkpoint: str, *, as_of: datetime | None = None,
                  report: Callable[[int, dict], None] | None = None,
                  after: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer that upserts every micro-batch of staged readings; the caller picks the trigger and starts it.

    There is no watermark and no streaming deduplication: a correction of any age is accepted, inside a
    micro-batch the last arrival of a key wins, and across batches and replays the merge changes only what
    differs. ``report`` gets the metrics of a batch, ``after`` its flagged rows once they are stored.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        now = as_of or datetime.now(timezone.utc)
        flagged = insertable(flag_readings(batch)).persist()
        try:
            counts = quality_counts(flagged)
            if counts["readings_fetched"]:
                counts.update(upsert_readings(batch.sparkSession, flagged, table, now))
                if after is not None:
                    after(flagged, batch_id)
            if report is not None:
                report(batch_id, counts)
        finally:
            flagged.unpersist()

    return staged.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def document_stream(documents: DataFrame, parse: Callable[[DataFrame], DataFrame], table: str, quarantine: str,
                    checkpoint: str, *, as_of: datetime | None = None,
                    report: Callable[[int, dict], None] | None = None) -> DataStreamWriter:
    """Landed documents to the table; unreadable ones go to the quarantine folder and stop nothing.

    ``documents`` is a streaming frame from the landed-file readers and ``parse`` turns readable documents
    into staged readings. Quarantined text is kept per micro-batch, so a replay overwrites its own output.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        now = as_of or datetime.now(timezone.utc)
        held = batch.persist()
        try:
            broken = held.where(F.col(CORRUPT_COLUMN).isNotNull()).select(F.col(CORRUPT_COLUMN).alias("value"))
            broken.write.mode("overwrite").text(f"{quarantine.rstrip('/')}/batch={batch_id}")
            readable = held.where(F.col(CORRUPT_COLUMN).isNull()).drop(CORRUPT_COLUMN)
            # One pass over all readings. What remains, a row per key with its counts, is what the later steps read.
            newest = written(counted_latest(insertable(flag_readings(parse(readable)))), "arrived")
            counts = arrival_counts(newest)
            counts["documents_quarantined"] = broken.count()
            if counts["readings_fetched"]:
                counts.update(upsert_readings(batch.sparkSession, newest, table, now, latest=True))
            if report is not None:
                report(batch_id, counts)
        finally:
            held.unpersist()

    return documents.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def cycle_stream(sources: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]], cities: DataFrame, base: str, *,
                 as_of: datetime | None = None) -> DataStreamWriter:
    """Landed documents of several sources as one stream of ingest cycles, each micro-batch one cycle.

    ``sources`` maps a name to a streaming frame of documents and the function that turns readable ones into staged
    readings. Below ``base`` a cycle upserts ``readings`` of active cities, and leaves, in a folder of its own number that
    a repeated cycle overwrites: ``quarantine`` (unreadable lines), ``errors`` (documents that report a failed fetch),
    ``stats`` (per active city: readings fetched, their flags, readings inserted and updated) and ``reports`` (one row:
    cities attempted, succeeded and failed, readings written). A city's failure stops no other. A cycle that is
    repeated after its readings were stored reports nothing written, since nothing was.
    """
    def packed(chosen: str) -> DataFrame:
        return sources[chosen][0].select(F.lit(chosen).alias("kind"), *[
            F.struct(*documents.columns).alias(name) if name == chosen
            else F.lit(None).cast(documents.schema).alias(name) for name, (documents, _) in sources.items()])

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, as_of or datetime.now(timezone.utc)
        folder = base.rstrip("/")

        def keep(rows: DataFrame, name: str) -> None:
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/cycle={batch_id}")

        held = batch.persist()
        try:
            each = {name: held.where(F.col("kind") == name).select(f"{name}.*") for name in sources}
            broken = [d.where(F.col(CORRUPT_COLUMN).isNotNull()).select(F.lit(n).alias("source"), F.col(CORRUPT_COLUMN).alias("line"))
                      for n, d in each.items()]
            readable = {n: d.where(F.col(CORRUPT_COLUMN).isNull()).drop(CORRUPT_COLUMN) for n, d in each.items()}
            errors = fetch_errors(*readable.values())
            keep(reduce(DataFrame.unionByName, broken), "quarantine")
            keep(errors, "errors")
            staged = insertable(stage_readings(cities, *[sources[n][1](d) for n, d in readable.items()])).persist()
            try:
                _, version = merge_into(spark, staged, f"{folder}/readings", now)
                counts = merged_by_city(spark, f"{folder}/readings", version)
                stats = ingest_stats(staged, cities).join(counts, "city_id", "left").fillna(
                    0, ["readings_inserted", "readings_updated"])
                keep(stats, "stats")
                keep(cycle_report(cities, counts, errors), "reports")
            finally:
                staged.unpersist()
        finally:
            held.unpersist()

    stream = reduce(DataFrame.unionByName, [packed(name) for name in sources])
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{base.rstrip('/')}/checkpoint")


def read_cycles(spark: SparkSession, base: str, name: str) -> DataFrame:
    """``quarantine``, ``errors``, ``stats`` or ``reports`` of all cycles, with the number of the ``cycle``."""
    return spark.read.option("basePath", f"{base.rstrip('/')}/{name}").parquet(f"{base.rstrip('/')}/{name}")
