"""Row numbers, ranks and pages over sorted groups of any size, without one task per group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airloom.session import written

ROW_BITS = 33  # monotonically_increasing_id counts rows of a partition in its lower 33 bits
SLICE, ROW, FIRST, BEFORE, HELD = (f"_positions_{n}" for n in ("slice", "row", "first", "before", "held"))


def matches(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equality on ``columns``, nulls being equal."""
    return reduce(and_, [left[c].eqNullSafe(right[c]) for c in columns], F.lit(True))


def numbered(df: DataFrame, group: list[str], order: list[Column | str], name: str = "position",
             total: str | None = None, slices: int | None = None) -> DataFrame:
    """``df`` with ``name``: each row's place in its group, from 0, by ``order``; ``total`` names the group's size.

    Rows are range partitioned by group and order, so a group of any size is cut into as many slices as it fills.
    A row's place is its place inside the slice plus the rows of the group in earlier slices; of those one
    count per slice and group is kept. Groups may be null. Rows that ``order`` cannot tell apart are numbered in
    the order of their files; rows of equal order lie in one slice, so give an order that splits hot values. The
    sorted rows are written to the shared folder once, since counts and rows must come from the same cut. No
    rows give no rows; no group columns give one group.
    """
    keys = [*[F.col(c).asc_nulls_first() for c in group], *order]
    sorted_rows = df.repartitionByRange(*([slices] if slices else []), *keys).sortWithinPartitions(*keys)
    rows = written(sorted_rows.withColumns({
        SLICE: F.spark_partition_id(),
        ROW: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))}), "positions")
    counts = rows.groupBy(SLICE, *group).agg(F.min(ROW).alias(FIRST), F.count("*").alias(HELD))
    # One row per slice in a group: the windows stay small whatever the group holds.
    earlier = W.partitionBy(*group).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    wanted = {BEFORE: F.coalesce(F.sum(HELD).over(earlier), F.lit(0)) - F.col(FIRST)}
    if total:
        wanted[total] = F.sum(HELD).over(W.partitionBy(*group))
    counts = written(counts.withColumns(wanted).drop(FIRST, HELD), "positions-counts")
    joined = rows.join(counts, matches(rows, counts, [SLICE, *group]))
    return joined.select(*[rows[c] for c in df.columns], (rows[ROW] + counts[BEFORE]).alias(name),
                         *([counts[total]] if total else []))


def ranked(df: DataFrame, group: list[str], value: str, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: its rank in the group by ``value`` from the lowest up, null last; equal values share a rank.

    A group of any size is numbered in slices. The first place of each value is its rank; it comes from one small sum per
    slice and value, so not even one value that all rows share is gathered in a task.
    """
    placed = numbered(df, group, [F.col(value).asc_nulls_last()], name=name)
    own = {f"_positions_key{i}": c for i, c in enumerate([*group, value])}
    first = placed.groupBy(*[F.col(c).alias(k) for k, c in own.items()]).agg((F.min(name) + 1).alias(FIRST))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for k, c in own.items()])
    return placed.drop(name).join(first, same).withColumnRenamed(FIRST, name).select(*df.columns, name)


def deep_page(df: DataFrame, order: list[str], skip: int, limit: int) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` of ``df`` by ``order``, however deep the page lies.

    The rows are sorted in slices and counted; the page is cut out by its places, which one or two slices hold, so no task
    ever holds what lies before it. To walk through pages one after the other, ``page`` with ``after`` is cheaper.
    """
    place = "_positions_place"
    found = numbered(df, [], order, name=place).where((F.col(place) >= skip) & (F.col(place) < skip + limit))
    return found.orderBy(place).drop(place)
