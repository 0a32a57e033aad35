"""Nested JSON documents out of flat results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_documents(rows: DataFrame, header: Sequence[str], items: Sequence[str], name: str) -> DataFrame:
    """One JSON document per distinct header, its items in the order of the first item column.

    For results with short item lists: trend buckets, compared or ranked cities. Results with unbounded
    lists, such as anomalies of all series, are written as rows instead.
    """
    return rows.groupBy(*header).agg(F.sort_array(F.collect_list(F.struct(*items))).alias(name)).select(
        *header, F.to_json(F.struct(*header, name)).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    documents.select("document").write.mode("errorifexists").text(path)
