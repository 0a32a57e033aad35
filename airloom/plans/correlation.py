"""Correlation of parameters measured at the same instants."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions.labels import correlation_direction, correlation_strength
from airloom.functions.numeric import pearson, round_half_up
from airloom.functions.times import days_before, to_utc
from airloom.operators.filters import city_names, usable_readings
from airloom.plans.trend import check_days


def paired_statistics(base: DataFrame, pairs: Sequence[tuple[str, str]], places: int) -> DataFrame:
    """city_id, param1, param2, pearson_r and sample_size for every pair, from one scan.

    The long table is turned wide on (city, timestamp) once, however many pairs are asked for. That key
    spreads evenly, and a pair is a row with both columns filled, so nothing is multiplied out.
    """
    names = sorted({name for pair in pairs for name in pair})
    at_instant = base.where(F.col("parameter").isin(names)).groupBy("city_id", "timestamp").agg(*[
        F.max(F.when(F.col("parameter") == name, F.col("value"))).alias(f"p{i}") for i, name in enumerate(names)])
    place = {name: f"p{i}" for i, name in enumerate(names)}
    measures = []
    for i, (first, second) in enumerate(pairs):
        a, b = F.col(place[first]), F.col(place[second])
        measures.append(F.struct(
            F.lit(first).alias("param1"), F.lit(second).alias("param2"),
            round_half_up(pearson(a, b), places).alias("pearson_r"),
            F.count_if(a.isNotNull() & b.isNotNull()).alias("sample_size"),
        ).alias(f"m{i}"))
    wide = at_instant.groupBy("city_id").agg(*measures)
    return wide.select("city_id", F.inline(F.array(*[f"m{i}" for i in range(len(pairs))])))


def correlations(readings: DataFrame, cities: DataFrame, pairs: Sequence[tuple[str, str]], *,
                 as_of: datetime | str | None = None, days: int = 30, city_ids: Sequence[str] | None = None,
                 include_suspect: bool = False, until: datetime | None = None) -> DataFrame:
    """Pearson correlation of several parameter pairs per active city.

    A city without common instants is reported with a NULL coefficient and a sample of 0.
    """
    check_days(days)
    pairs = list(dict.fromkeys(tuple(pair) for pair in pairs))
    if not pairs or any(a == b for a, b in pairs):
        raise ValueError("a correlation needs two different parameters")
    base = usable_readings(readings, since=days_before(to_utc(as_of), days), until=until, city_ids=city_ids,
                           include_suspect=include_suspect)
    names = city_names(cities)
    if city_ids is not None:
        names = names.where(F.col("city_id").isin(list(city_ids)))
    asked = names.withColumn("pair", F.explode(F.array(*[
        F.struct(F.lit(a).alias("param1"), F.lit(b).alias("param2")) for a, b in pairs
    ]))).select("city_id", "city_name", "pair.param1", "pair.param2")
    measured = paired_statistics(base, pairs, 6)
    r = F.col("pearson_r")
    return asked.join(measured, ["city_id", "param1", "param2"], "left").select(
        "city_id", "city_name", "param1", "param2", F.lit(days).alias("days"), r,
        F.coalesce("sample_size", F.lit(0).cast("long")).alias("sample_size"),
        correlation_strength(r).alias("interpretation"), correlation_direction(r).alias("direction"),
    )


def correlation(readings: DataFrame, cities: DataFrame, param1: str, param2: str, **options) -> DataFrame:
    """One pair; options as for :func:`correlations`."""
    return correlations(readings, cities, [(param1, param2)], **options)


def all_pairs(parameters: Sequence[str]) -> list[tuple[str, str]]:
    """Every unordered pair of a parameter list, for a correlation matrix."""
    ordered = sorted(set(parameters))
    return [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1:]]
