"""The insight cache: newest rows, appends, extensions and the token audit."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airloom.functions.times import instant
from airloom.schemas import INSIGHT_CACHE
from airloom.sources.tables import read_table, replace_partitions, touched_partitions

CACHE_TTL_SECONDS = 3600


def read_insights(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, INSIGHT_CACHE)


def latest_insights(cache: DataFrame, as_of: datetime, *, allow_expired: bool = False) -> DataFrame:
    """The newest insight of every city, among the unexpired ones unless all are allowed."""
    pool = cache if allow_expired else cache.where(F.col("expires_at") > instant(as_of))
    newest = W.partitionBy("city_id").orderBy(F.col("generated_at").desc(), F.col("id").desc())
    return pool.withColumn("_age", F.row_number().over(newest)).where("_age = 1").drop("_age")


def new_insights(texts: DataFrame, as_of: datetime, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Rows for freshly written insights.

    ``texts``: city_id, insight_text, context_hash, model_used, input_tokens, output_tokens.
    """
    now = instant(as_of)
    made = F.sha2(F.concat_ws("#", "city_id", F.unix_micros(now).cast("string"), "context_hash"), 256)
    return texts.withColumns({
        "id": made, "generated_at": now, "expires_at": instant(as_of + timedelta(seconds=ttl_seconds)),
        "created_at": now, "updated_at": now, "generated_date": F.to_date(now),
    }).select(*INSIGHT_CACHE.fieldNames())


def append_insights(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("generated_date").parquet(path)


def extended(cache: DataFrame, ids: DataFrame, as_of: datetime, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """The cache with the named rows valid for another period."""
    named = ids.select("id").distinct().withColumn("renewed", F.lit(True))
    hit = F.col("renewed").isNotNull()
    return cache.join(named, "id", "left").withColumns({
        "expires_at": F.when(hit, instant(as_of + timedelta(seconds=ttl_seconds))).otherwise(F.col("expires_at")),
        "updated_at": F.when(hit, instant(as_of)).otherwise(F.col("updated_at")),
    }).select(*cache.columns)


def extend_insights(spark: SparkSession, rows: DataFrame, path: str, as_of: datetime,
                    ttl_seconds: int = CACHE_TTL_SECONDS) -> None:
    """Extend the given cache rows (id, generated_date) in the table, rewriting only their days."""
    stored = touched_partitions(read_insights(spark, path), rows, ["generated_date"])
    replace_partitions(extended(stored, rows, as_of, ttl_seconds), path, ["generated_date"], ["city_id"])


def token_audit(cache: DataFrame) -> DataFrame:
    """Tokens spent per city, model and day; input and output are priced differently and stay apart."""
    return cache.groupBy("city_id", "model_used", F.to_date("generated_at").alias("day")).agg(
        F.sum(F.col("input_tokens").cast("long")).alias("input_tokens"),
        F.sum(F.col("output_tokens").cast("long")).alias("output_tokens"),
        F.count(F.lit(1)).alias("insights"),
    )
