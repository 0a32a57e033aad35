"""Parquet tables: readings in layers by parameter and day, insights by day, the city dimension."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.functions.times import instant
from airloom.operators.filters import active, changed_since
from airloom.operators.upsert import merge_readings
from airloom.schemas import CITIES, INSIGHT_CACHE, READING_KEY, READING_PARTITIONS, READINGS, VALID
from airloom.session import written
from airloom.sources.layers import MOST_LAYERS, REPLACED, Layout, append_layer, commits, compact, read_layers, read_log

# The log tells per city what arrived, so freshness and changed days need no look at the readings.
READINGS_LAYOUT = Layout(
    READINGS, keys=tuple(READING_KEY), partitions=tuple(READING_PARTITIONS), sort=("city_id", "timestamp"), group=("city_id",),
    figures={"valid": "sum(valid_change)", "last_created_at": "max(created_at)", "last_updated_at": "max(updated_at)",
             "last_timestamp": "max(timestamp)"})


def create_tables(spark: SparkSession, base: str, database: str = "default") -> None:
    """Declare the three tables below ``base``; running it again changes nothing."""
    layouts = (("readings", READINGS, READING_PARTITIONS), ("cities", CITIES, []),
               ("insight_cache", INSIGHT_CACHE, ["generated_date"]))
    for name, schema, partitions in layouts:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        clause = f"PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet {clause} "
                  f"LOCATION '{base.rstrip('/')}/{name}'")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table under its declared schema; a table that was never written is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _flat_readings(spark: SparkSession, path: str) -> DataFrame:
    """Readings in plain partition folders, as other tools write them."""
    return read_table(spark, path, READINGS)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """The readings table; plain partition folders are read as they are until the first upsert takes them in."""
    return read_layers(spark, path, READINGS_LAYOUT) if commits(spark, path) else _flat_readings(spark, path)


def store_readings(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Add whole readings, dates and ids included, whose keys the table does not hold yet."""
    append_layer(spark, path, READINGS_LAYOUT, rows.withColumns({
        REPLACED: F.lit(False), "valid_change": (F.col("quality_flag") == VALID).cast("int")}))


def compact_readings(spark: SparkSession, path: str, most_layers: int = MOST_LAYERS) -> int:
    """Rewrite the partitions that many commits have touched; returns how many there were."""
    return compact(spark, path, READINGS_LAYOUT, most_layers, {"valid_change": (F.col("quality_flag") == VALID).cast("int")})


def reading_log(spark: SparkSession, path: str) -> DataFrame:
    """What the commits did, a row per commit, partition and city: the table answers from it what needs no reading.

    ``rows`` written and ``replaced`` of them, ``valid`` (by how much the number of valid readings moved), and the last
    ``created_at``, ``updated_at`` and ``timestamp`` among them.
    """
    log = read_log(spark, path)
    names = {"p_parameter": "parameter", "p_reading_date": "reading_date", "g_city_id": "city_id"}
    if log is not None:
        return log.withColumnsRenamed(names)
    return spark.createDataFrame([], "parameter string, reading_date date, city_id string, version string, kind string, "
                                     "rows long, replaced long, valid long, last_created_at timestamp, "
                                     "last_updated_at timestamp, last_timestamp timestamp")


def changed_readings(spark: SparkSession, path: str, moment: datetime) -> DataFrame:
    """Readings inserted or corrected after ``moment``, from the partitions that the log says hold any."""
    log = reading_log(spark, path).where(F.col("last_updated_at") > instant(moment)).select(*READING_PARTITIONS)
    return changed_since(read_layers(spark, path, READINGS_LAYOUT, touched=log), moment)


def replace_partitions(df: DataFrame, path: str, partitions: list[str], sort: list[str]) -> None:
    """Overwrite exactly the partitions that occur in ``df``.

    The rebalance hint lets adaptive execution split a partition that is too large for one task and join
    small ones, so neither a busy day nor many quiet ones shape the file sizes. Sorted files give every
    row group a narrow range of cities and times.
    """
    (
        df.hint("rebalance", *partitions).sortWithinPartitions(*partitions, *sort)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    )


def touched_partitions(table: DataFrame, batch: DataFrame, partitions: list[str]) -> DataFrame:
    """The rows of ``table`` in the partitions that ``batch`` falls into.

    The first and last value of each partition column, one row whatever the batch, prune directories before
    anything is read; a semi join then leaves exactly the partitions touched.
    """
    ends = batch.agg(*[f(name).alias(f"{f.__name__}_{name}") for name in partitions for f in (F.min, F.max)]).first()
    for name in partitions:
        table = table.where(F.col(name).between(F.lit(ends[f"min_{name}"]), F.lit(ends[f"max_{name}"])))
    return table.join(batch.select(*partitions).distinct(), partitions, "left_semi")


def merge_into(spark: SparkSession, batch: DataFrame, path: str, as_of: datetime, *,
               latest: bool = False) -> tuple[dict[str, int], str | None]:
    """Merge a flagged batch into the readings table: inserted and changed rows become one more layer of their days.

    The batch is compared with the partitions it falls into and with nothing else; rows already stored are never
    written again. All of it counts at once, when the log entry is written; a writer that dies before leaves the table
    as it was. Replaying a batch changes nothing and commits nothing. One writer at a time. ``latest`` says that the batch
    has one row per key already. Returns the number of inserted and updated readings, and the version under which the log
    tells more of them.
    """
    if not commits(spark, path):
        flat = _flat_readings(spark, path)
        if not flat.isEmpty():
            store_readings(spark, flat, path)
    dated = batch.withColumn("reading_date", F.to_date("timestamp"))
    stored = read_layers(spark, path, READINGS_LAYOUT, touched=dated)
    merged = merge_readings(stored, dated.drop("reading_date"), as_of, kept=False, latest=latest)
    rows = merged.where(F.col("action").isin("inserted", "updated")).withColumn(REPLACED, F.col("action") == "updated")
    # A cached frame that reads the table would be computed again once the table is written to.
    rows = written(rows, "merged")
    counts = rows.agg(F.count_if(~F.col(REPLACED)).alias("inserted"), F.count_if(REPLACED).alias("updated")).first().asDict()
    return counts, append_layer(spark, path, READINGS_LAYOUT, rows) if any(counts.values()) else None


def upsert_readings(spark: SparkSession, batch: DataFrame, path: str, as_of: datetime, *, latest: bool = False) -> dict[str, int]:
    """:func:`merge_into`, returning the number of inserted and updated readings."""
    return merge_into(spark, batch, path, as_of, latest=latest)[0]


def merged_by_city(spark: SparkSession, path: str, version: str | None) -> DataFrame:
    """Readings inserted and updated per city by one commit, from the log; none for a batch that changed nothing."""
    log = reading_log(spark, path).where(F.col("version").eqNullSafe(F.lit(version)))
    return log.groupBy("city_id").agg((F.sum("rows") - F.sum("replaced")).alias("readings_inserted"),
                                      F.sum("replaced").alias("readings_updated"))


def write_cities(cities: DataFrame, path: str) -> None:
    """A new copy of the dimension; the caller points its readers at ``path``."""
    cities.select(*CITIES.fieldNames()).write.mode("errorifexists").parquet(path)


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, CITIES)


def register_views(readings: DataFrame, cities: DataFrame) -> None:
    readings.createOrReplaceTempView("readings")
    cities.createOrReplaceTempView("cities")


def run_sql(spark: SparkSession, text: str, parameters: dict) -> DataFrame:
    """SQL with bound ``:name`` parameters over the registered views."""
    return spark.sql(text, args=parameters)


def reading_view(readings: DataFrame) -> DataFrame:
    """The columns a consumer of single readings sees."""
    return readings.select("city_id", "parameter", "value", "unit", "raw_value", "raw_unit", "quality_flag",
                           "source", "timestamp")


def ingest_targets(cities: DataFrame) -> DataFrame:
    """Active cities only; readings of others are not taken in."""
    return active(cities).select(F.col("id").alias("city_id"))
