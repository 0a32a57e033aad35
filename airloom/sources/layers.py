"""Partitioned tables in layers: a commit adds files, and its entry in the log, written last, makes them count.

    <table>/data/<partition columns>/version=<v>/*.parquet   rows of one commit in one partition
    <table>/log/<v>/*.parquet                                 what the commit did, per partition and group

A log folder counts once its job has finished. A writer that dies before that leaves files that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.operators.positions import matches

VERSION, KIND, ROWS, REPLACED = "version", "kind", "rows", "replaced"
CHANGE, BASE = "change", "base"  # a base stands for everything its partition held before
WHOLE = "-whole"  # ends the name of a log entry that stands for all before it
MOST_LAYERS = 8
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder of a null


@dataclass(frozen=True)
class Layout:
    """Columns of a table, the key its rows are replaced by, its partitions, and what the log tells of a commit.

    The log has a row per partition and ``group`` with the number of rows, of those that replace a stored one, and
    ``figures``: named SQL aggregates over the rows, which may use further columns that the writer hands over.
    """

    schema: T.StructType
    keys: tuple[str, ...]
    partitions: tuple[str, ...]
    sort: tuple[str, ...] = ()
    group: tuple[str, ...] = ()
    figures: dict[str, str] = field(default_factory=dict, hash=False)

    @cached_property
    def stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(VERSION, T.StringType())])


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(entry.getPath().toString() for entry in found) if found else []


def commits(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished log entries that count, oldest first."""
    names = sorted(p.split("/")[-2] for p in _listed(spark, f"{path.rstrip('/')}/log/*/_SUCCESS"))
    whole = [i for i, name in enumerate(names) if name.endswith(WHOLE)]
    return names[whole[-1]:] if whole else names


def _next(names: Sequence[str]) -> str:
    """A name after all others. Its second part makes the files of a writer that died different from those of the next."""
    return f"{int(names[-1][:9]) + 1 if names else 0:09d}-{uuid.uuid4().hex[:8]}"


def read_log(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame | None:
    """The log rows of all layers that count; None for a table that was never written."""
    names = commits(spark, path) if names is None else names
    if not names:
        return None
    base = f"{path.rstrip('/')}/log"
    rows = spark.read.parquet(*[f"{base}/{name}" for name in names])
    partitions = [c for c in rows.columns[:rows.columns.index(VERSION)] if c.startswith("p_")]
    # One row per partition that was ever rewritten.
    bases = rows.where(F.col(KIND) == BASE).groupBy(*partitions).agg(F.max(VERSION).alias("base"))
    joined = rows.join(bases, matches(rows, bases, partitions), "left")
    return joined.where(bases["base"].isNull() | (rows[VERSION] >= bases["base"])).select(rows["*"])


def layers(spark: SparkSession, path: str, layout: Layout, names: Sequence[str] | None = None) -> DataFrame | None:
    """Partition columns, ``version`` and ``mixed`` of every layer that counts.

    ``mixed`` tells that some layer of the partition replaces rows of another; otherwise all of them simply add up.
    """
    log = read_log(spark, path, names)
    if log is None:
        return None
    parts = [F.col(f"p_{c}").alias(c) for c in layout.partitions]
    each = log.groupBy(*parts, VERSION).agg(F.sum(REPLACED).alias(REPLACED))
    whole = each.groupBy(*layout.partitions).agg((F.sum(REPLACED) > 0).alias("mixed"), F.collect_list(VERSION).alias("held"))
    return whole.select(*layout.partitions, "mixed", F.size("held").alias("layers"), F.explode("held").alias(VERSION))


def read_layers(spark: SparkSession, path: str, layout: Layout, touched: DataFrame | None = None) -> DataFrame:
    """The rows of the table, of rows with one key the newest; a table that was never written is empty.

    With ``touched`` only the partitions that its rows fall into. The join with the layers prunes directories when it
    runs; the first and last value of each partition column of ``touched`` prune them before. Only partitions in
    which rows were replaced pay for finding the newest.
    """
    columns = layout.schema.fieldNames()
    found = layers(spark, path, layout)
    if found is None:
        return spark.createDataFrame([], layout.schema)
    data = spark.read.schema(layout.stored).parquet(f"{path.rstrip('/')}/data")
    if touched is not None:
        ends = touched.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in layout.partitions for f in (F.min, F.max)]).first()
        for c in layout.partitions:
            data = data.where(F.col(c).between(F.lit(ends[f"min_{c}"]), F.lit(ends[f"max_{c}"])))
        found = found.join(touched.select(*layout.partitions).distinct(), list(layout.partitions), "left_semi")
    on = [*layout.partitions, VERSION]
    plain = data.join(found.where("not mixed"), on, "left_semi").select(*columns)
    rest = [c for c in columns if c not in layout.keys]
    newest = data.join(found.where("mixed"), on, "left_semi").groupBy(*layout.keys).agg(
        F.max_by(F.struct(*rest), VERSION).alias("row")).select(*layout.keys, "row.*")
    return plain.unionByName(newest.select(*columns))


def _put(spark: SparkSession, path: str, layout: Layout, rows: DataFrame, name: str, kind: str) -> None:
    """Files first, then the log entry. The rebalance hint splits a large partition over tasks and joins small ones."""
    told = rows.groupBy(*[F.col(c).alias(f"p_{c}") for c in layout.partitions], *[F.col(c).alias(f"g_{c}") for c in layout.group]).agg(
        F.lit(name).alias(VERSION), F.lit(kind).alias(KIND), F.count(F.lit(1)).alias(ROWS),
        F.sum(F.col(REPLACED).cast("long")).alias(REPLACED), *[F.expr(text).alias(n) for n, text in layout.figures.items()])
    sort = [*layout.partitions, *layout.sort]
    (rows.select(*layout.schema.fieldNames(), F.lit(name).alias(VERSION)).hint("rebalance", *layout.partitions)
     .sortWithinPartitions(*sort).write.mode("append").partitionBy(*layout.partitions, VERSION).parquet(f"{path.rstrip('/')}/data"))
    write_log(told, path, name)


def write_log(told: DataFrame, path: str, name: str) -> None:
    """The moment from which a commit counts: the job that writes its log entry has finished."""
    told.write.mode("error").parquet(f"{path.rstrip('/')}/log/{name}")


def append_layer(spark: SparkSession, path: str, layout: Layout, rows: DataFrame) -> str:
    """Commit ``rows`` as a change: ``replaced`` tells which of them replace a stored row of their key.

    ``rows`` is evaluated twice, so a costly frame should be persisted. One writer at a time: a second one that
    commits meanwhile is an error.
    """
    names = commits(spark, path)
    name = _next(names)
    _put(spark, path, layout, rows, name, CHANGE)
    _check_alone(spark, path, name)
    return name


def _check_alone(spark: SparkSession, path: str, name: str) -> None:
    if [n for n in commits(spark, path) if n[:9] == name[:9]] != [name]:
        raise RuntimeError(f"another writer has committed to {path} meanwhile")


def compact(spark: SparkSession, path: str, layout: Layout, most_layers: int = MOST_LAYERS,
            also: dict[str, Column] | None = None) -> int:
    """Rewrite partitions of more than ``most_layers`` layers as one; returns how many there were.

    Readers of the old layers go on undisturbed: their files stay until :func:`expire`. ``also`` adds the columns that the
    layout's figures need.
    """
    found = layers(spark, path, layout)
    if found is None:
        return 0
    full = found.where(F.col("layers") > most_layers).select(*layout.partitions).distinct()
    count = full.count()
    if count:
        rows = read_layers(spark, path, layout, touched=full).withColumns({REPLACED: F.lit(False), **(also or {})})
        name = _next(commits(spark, path))
        _put(spark, path, layout, rows, name, BASE)
        _check_alone(spark, path, name)
    return count


def roll_up(spark: SparkSession, path: str) -> None:
    """One log entry in place of all: later reads list and read a single folder."""
    log = read_log(spark, path)
    if log is not None:
        write_log(log, path, _next(commits(spark, path)) + WHOLE)


def expire(spark: SparkSession, path: str, layout: Layout) -> int:
    """Delete the files of layers that no longer count; returns how many folders went.

    To be run when no reader of an older state is left. Files of writers that died are among them.
    """
    live = layers(spark, path, layout)
    if live is None:
        return 0
    depth = len(layout.partitions) + 1
    folders = _listed(spark, f"{path.rstrip('/')}/data/{'/'.join('*' for _ in layout.partitions)}/{VERSION}=*")
    values = [[unquote(part.split("=", 1)[1]) for part in folder.split("/")[-depth:]] for folder in folders]
    on = [*layout.partitions, VERSION]
    there = spark.createDataFrame([(f, *[None if v == NO_VALUE else v for v in row]) for f, row in zip(folders, values)],
                                  ", ".join(f"`{c}` string" for c in ["_folder", *on]))
    live = live.select(*[F.col(c).cast("string").alias(c) for c in on])
    gone = 0
    for row in there.join(live, matches(there, live, on), "left_anti").toLocalIterator():
        target = spark._jvm.org.apache.hadoop.fs.Path(row["_folder"])
        gone += bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))
    return gone
