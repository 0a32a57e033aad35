"""Rolling baseline over the preceding rows of each series, one path for series of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airloom.operators.positions import numbered
from airloom.schemas import SERIES_KEY

FRAME_ROWS = 168
BLOCK_FRAMES = 300  # a block is so many frames long, about 50,000 rows
PLACE, BLOCK, STRETCH, BEFORE, ONWARD = (f"_rolling_{n}" for n in ("place", "block", "stretch", "before", "onward"))


def placed_rows(base: DataFrame) -> DataFrame:
    """``base`` in the shared folder with every row's place in its series by time.

    The places come from range partitions and exact counts, so neither a series that holds most of the rows nor
    a stray timestamp far from the others makes one task larger than the rest.
    """
    return numbered(base, SERIES_KEY, ["timestamp"], name=PLACE)


def _summary(window: W) -> Column:
    """What can be merged with another stretch: rows, values, their mean, squared distances from it, and bounds."""
    value = F.col("value")
    values = F.count(value).over(window)
    return F.struct(
        F.count(F.lit(1)).over(window).alias("rows"), values.alias("values"), F.avg(value).over(window).alias("mean"),
        (F.var_pop(value).over(window) * values).alias("squares"),
        F.min(value).over(window).alias("low"), F.max(value).over(window).alias("high"))


def _merged(a: Column, b: Column) -> dict[str, Column]:
    """Mean, sample deviation and row count of two stretches together; either may be empty or absent."""
    left, right = F.coalesce(a["values"], F.lit(0)), F.coalesce(b["values"], F.lit(0))
    values = left + right
    both = F.nullif(values, F.lit(0))
    apart = F.coalesce(b["mean"] - a["mean"], F.lit(0.0))
    mean = (F.coalesce(a["mean"] * left, F.lit(0.0)) + F.coalesce(b["mean"] * right, F.lit(0.0))) / both
    squares = F.coalesce(a["squares"], F.lit(0.0)) + F.coalesce(b["squares"], F.lit(0.0)) + apart * apart * left * right / both
    low, high = F.least(a["low"], b["low"]), F.greatest(a["high"], b["high"])
    # Equal values have no spread: rounding must not give them any.
    flat = (low == high) & ~F.isnan(low)
    return {
        "rolling_avg": F.when(flat, low).otherwise(mean),
        "rolling_stddev": F.when(values > 1, F.when(flat, 0.0).otherwise(F.sqrt(squares / (values - 1)))),
        "window_size": F.coalesce(a["rows"], F.lit(0)) + F.coalesce(b["rows"], F.lit(0)),
    }


def framed(placed: DataFrame, *, frame_rows: int = FRAME_ROWS, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """:func:`rolling_baseline` of rows that have their places already.

    Series are cut into blocks of ``block_frames`` frames by row number, and the last frame of a block also leads the
    next one, so a block holds all its rows look back on. Inside a block, stretches of one frame's length start at
    fixed places. The rows before a reading are then the end of the stretch before its own and the beginning of its own:
    both are running summaries, and the two are merged. A row costs the same whatever the frame's length.
    """
    place = F.col(PLACE)
    own, stretch = F.floor(place / (frame_rows * block_frames)), F.floor(place / frame_rows)
    leads = stretch % block_frames == block_frames - 1
    blocks = placed.withColumns({
        STRETCH: stretch, BLOCK: F.explode(F.when(leads, F.array(own, own + 1)).otherwise(F.array(own)))})
    block = W.partitionBy(*SERIES_KEY, BLOCK)
    inside = W.partitionBy(*SERIES_KEY, BLOCK, STRETCH)
    summed = blocks.withColumns({
        ONWARD: _summary(inside.orderBy(place.desc()).rowsBetween(W.unboundedPreceding, 0)),
        BEFORE: _summary(inside.orderBy(place).rowsBetween(W.unboundedPreceding, -1))})
    earlier = summed.withColumn(ONWARD, F.lag(ONWARD, frame_rows).over(block.orderBy(place)))
    made = earlier.where(F.col(BLOCK) == own).withColumns(_merged(F.col(ONWARD), F.col(BEFORE)))
    return made.drop(PLACE, BLOCK, STRETCH, BEFORE, ONWARD)


def rolling_baseline(base: DataFrame, *, frame_rows: int = FRAME_ROWS, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Add mean, sample deviation and row count of the ``frame_rows`` rows before each reading.

    The current row is not part of its own baseline, and the frame counts rows, not hours. Null values count as
    rows but not as values. The sorted rows are written to the shared folder once.
    """
    return framed(placed_rows(base), frame_rows=frame_rows, block_frames=block_frames)
