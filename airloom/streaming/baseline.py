"""Rolling baselines kept up to date as readings arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.functions.numeric import round_half_up, z_score
from airloom.operators.positions import numbered
from airloom.operators.rolling import FRAME_ROWS, PLACE, framed
from airloom.operators.upsert import latest_per_key
from airloom.schemas import SERIES_KEY, VALID
from airloom.session import written
from airloom.sources.layers import REPLACED, Layout, append_layer, compact, read_layers
from airloom.sources.tables import READINGS_LAYOUT, compact_readings, reading_log

BUCKETS = 32
COMPACT_EVERY = 32

_series = [T.StructField(name, T.StringType()) for name in SERIES_KEY]
SCORES_LAYOUT = Layout(
    T.StructType([*_series, T.StructField("timestamp", T.TimestampType()), T.StructField("value", T.DoubleType()),
                  T.StructField("rolling_avg", T.DoubleType()), T.StructField("rolling_stddev", T.DoubleType()),
                  T.StructField("z_score", T.DoubleType()), T.StructField("window_size", T.LongType()),
                  T.StructField("reading_date", T.DateType())]),
    keys=(*SERIES_KEY, "timestamp"), partitions=("parameter", "reading_date"), sort=("city_id", "timestamp"))
# The last readings of every series, ``nth`` from its end; ``total`` valid readings and the last moment seen at that time.
TAILS_LAYOUT = Layout(
    T.StructType([*_series, T.StructField("nth", T.LongType()), T.StructField("timestamp", T.TimestampType()),
                  T.StructField("value", T.DoubleType()), T.StructField("total", T.LongType()),
                  T.StructField("last_seen", T.TimestampType()), T.StructField("bucket", T.IntegerType())]),
    keys=(*SERIES_KEY, "nth"), partitions=("bucket",), sort=(*SERIES_KEY, "nth"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*SERIES_KEY), F.lit(BUCKETS)).cast("int").alias("bucket")


def touched_spans(batch: DataFrame) -> DataFrame:
    """First and last instant a batch touches in each series, and how many valid readings it brings."""
    newest = latest_per_key(batch)
    return newest.groupBy(*SERIES_KEY).agg(
        F.min("timestamp").alias("first_touched"), F.max("timestamp").alias("last_touched"),
        F.count_if(F.col("quality_flag") == VALID).alias("brought"))


def series_state(batch: DataFrame, log: DataFrame, tails: DataFrame) -> DataFrame:
    """Touched series with what is known of them, and whether they merely go on (``in_order``).

    They do if everything touched lies after all that was ever seen of the series, and if the tail together with the
    batch accounts for all valid readings that the log counts. Anything else, a correction, a late or repeated
    batch, or readings that came past the scores, is looked up in the table.
    """
    spans = touched_spans(batch)
    known = tails.groupBy(*SERIES_KEY).agg(F.max("total").alias("tail_total"), F.max("last_seen").alias("tail_seen"))
    counted = log.join(spans.select(*SERIES_KEY), SERIES_KEY, "left_semi").groupBy(*SERIES_KEY).agg(F.sum("valid").alias("total"), F.max("last_timestamp").alias("last_seen"))
    joined = spans.join(known, SERIES_KEY, "left").join(counted, SERIES_KEY, "left")
    later = F.col("tail_seen").isNull() | (F.col("first_touched") > F.col("tail_seen"))
    complete = F.coalesce("tail_total", F.lit(0)) + F.col("brought") == F.coalesce("total", F.lit(0))
    # Readings that came past the scores lie after the last one seen, unless they were late as well.
    start = F.when(later & ~complete, F.least("first_touched", "tail_seen")).otherwise(F.col("first_touched"))
    return joined.withColumns({"in_order": later & complete, "first_touched": start})


def days_to_read(late: DataFrame, log: DataFrame, frame_rows: int) -> DataFrame:
    """For every late series the days that its new scores and its new tail need, and which of them to score again.

    The log counts the valid readings of each day. Going back from the first touched day, days are taken until they hold
    a whole frame, however sparse the series; going on from the last one likewise, since a reading takes part in the
    baselines of the frame after it; and back from the end for the tail. One row per series and day is looked at.
    """
    days = log.join(late.select(*SERIES_KEY, "first_touched", "last_touched"), SERIES_KEY).groupBy(
        *SERIES_KEY, "first_touched", "last_touched", "reading_date").agg(F.sum("valid").alias("held")).where("held > 0")
    day, first, last = F.col("reading_date"), F.to_date("first_touched"), F.to_date("last_touched")
    backward = W.partitionBy(*SERIES_KEY).orderBy(day.desc()).rowsBetween(W.unboundedPreceding, -1)
    forward = W.partitionBy(*SERIES_KEY).orderBy(day).rowsBetween(W.unboundedPreceding, -1)

    def held(where: Column, window: W) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("held"))).over(window), F.lit(0))

    marked = days.withColumns({
        "leads": (day < first) & (held(day < first, backward) < frame_rows),
        "follows": (day > last) & (held(day > last, forward) < frame_rows),
        "ends": held(F.lit(True), backward) < frame_rows})
    scored = F.col("leads") | F.col("follows") | day.between(first, last)
    return marked.where(scored | F.col("ends")).select(*SERIES_KEY, "reading_date", "first_touched", scored.alias("scored"))


def rows_to_score(spark: SparkSession, table: str, batch: DataFrame, state: DataFrame, log: DataFrame, tails: DataFrame,
                  frame_rows: int) -> DataFrame:
    """``timestamp, value`` of the readings that touched series need, and which of them to ``report``.

    Series in order are made of their tail and the batch: the table is not read for them.
    """
    in_order, late = state.where("in_order").select(*SERIES_KEY), state.where("not in_order")
    columns = [*SERIES_KEY, "timestamp", "value"]
    old = tails.where(F.col("timestamp").isNotNull()).join(in_order, SERIES_KEY, "left_semi").select(
        *columns, F.lit(False).alias("report"))
    new = latest_per_key(batch).where(F.col("quality_flag") == VALID).join(in_order, SERIES_KEY, "left_semi").select(
        *columns, F.lit(True).alias("report"))
    days = written(days_to_read(late, log, frame_rows), "baseline-days")
    readings = read_layers(spark, table, READINGS_LAYOUT, touched=days).where(F.col("quality_flag") == VALID)
    again = readings.join(days, [*SERIES_KEY, "reading_date"]).select(
        *columns, (F.col("scored") & (F.col("timestamp") >= F.col("first_touched"))).alias("report"))
    return old.unionByName(new).unionByName(again)


def _commit(spark: SparkSession, path: str, layout: Layout, rows: DataFrame) -> None:
    """One more layer, unless there are no rows. Files and log entry come from one evaluation."""
    rows = rows.persist()
    try:
        if not rows.isEmpty():
            append_layer(spark, path, layout, rows)
    finally:
        rows.unpersist()


def score_writer(table: str, scores: str, tails: str, *, frame_rows: int = FRAME_ROWS,
                 compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """An ``after`` step for the ingest stream that keeps scores, and the tail of every series, next to the readings.

    The tail holds the last ``frame_rows`` valid readings of a series. Readings that arrive in order are scored from it
    and never look at the table; a late one or a correction reads the days around it that the log names. Tails are
    committed before scores: after a failure in between, the repeated batch finds itself already seen and
    is looked up like a correction. Scores of readings that a correction turned suspect or missing are left
    behind by the upsert; readers join to the valid readings, as :func:`current_scores` does.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = reading_log(spark, table)
        touched = batch.select(*SERIES_KEY).distinct().withColumn("bucket", _bucket())
        held = read_layers(spark, tails, TAILS_LAYOUT, touched=touched).join(touched.drop("bucket"), SERIES_KEY, "left_semi")
        state = written(series_state(batch, log, held), "baseline-series")
        rows = rows_to_score(spark, table, batch, state, log, held, frame_rows)
        # One sort serves both: places in time for the frames, places from the end for the tail.
        placed = numbered(rows, SERIES_KEY, ["timestamp"], name=PLACE, total="held")
        ended = placed.withColumn("nth", F.col("held") - F.col(PLACE)).where(F.col("nth") <= frame_rows).select(
            *SERIES_KEY, "nth", "timestamp", "value")
        slots = state.select(*SERIES_KEY, F.col("total").cast("long").alias("total"), "last_seen", "in_order",
                             F.explode(F.sequence(F.lit(1).cast("long"), F.lit(frame_rows).cast("long"))).alias("nth"))
        # A late batch may also shorten a series: its other places are emptied.
        tail = slots.join(ended, [*SERIES_KEY, "nth"], "left").where(F.col("timestamp").isNotNull() | ~F.col("in_order") | (F.col("nth") == 1))
        _commit(spark, tails, TAILS_LAYOUT, tail.select(
            *SERIES_KEY, "nth", "timestamp", "value", "total", "last_seen", _bucket(), F.lit(True).alias(REPLACED)))
        scored = framed(placed.drop("held"), frame_rows=frame_rows).where("report").join(
            state.select(*SERIES_KEY, (~F.col("in_order")).alias(REPLACED)), SERIES_KEY)
        z = z_score(F.col("value"), F.col("rolling_avg"), F.col("rolling_stddev"))
        _commit(spark, scores, SCORES_LAYOUT, scored.select(
            *SERIES_KEY, "timestamp", "value", round_half_up(F.col("rolling_avg"), 4).alias("rolling_avg"),
            round_half_up(F.col("rolling_stddev"), 4).alias("rolling_stddev"),
            round_half_up(z, 4).alias("z_score"), "window_size", F.to_date("timestamp").alias("reading_date"), REPLACED))
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact(spark, tails, TAILS_LAYOUT)
            compact(spark, scores, SCORES_LAYOUT)
            compact_readings(spark, table)

    return write


def read_scores(spark: SparkSession, scores: str) -> DataFrame:
    return read_layers(spark, scores, SCORES_LAYOUT)


def current_scores(readings: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of the readings that are valid now."""
    valid = readings.where(F.col("quality_flag") == VALID).select(*SERIES_KEY, "timestamp")
    return scores.join(valid, [*SERIES_KEY, "timestamp"], "left_semi")
