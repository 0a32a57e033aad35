"""What the operators share: whole texts of a table, tables in the shared folder, groups out of sorted batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.session import ensure_checkpoint_folder, written

# The letters that lower-casing touches and the characters that separate words.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the whole text, null counting as empty; extra columns do not come along."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def words_of(text: str) -> list[bytes]:
    """UTF-8 words with A-Z lower-cased. ``bytes.split`` parts at exactly space and 0x09 to 0x0D."""
    return text.encode().lower().split()


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_digest(docs: DataFrame) -> Column:
    """SHA-256 of the text column, null counting as empty."""
    return F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"), 256)


def chosen(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` named in ``rows`` (``doc_id``, ``sha``), whole; of rows equal in both one stays."""
    sha = fresh(docs, "sha")
    named = docs.withColumn(sha, text_digest(docs))
    kept = named.join(rows, named["doc_id"].cast("long").eqNullSafe(rows["doc_id"]) & (named[sha] == rows["sha"]), "left_semi")
    return kept.dropDuplicates(["doc_id", sha]).drop(sha)


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id has remainder 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus, F.lit(0))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps do not depend on lost executors."""
    ensure_checkpoint_folder(df.sparkSession)
    return written(df, f"llm-{name}")


def groups(batches: Iterable[pd.DataFrame], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal ``key`` in batches sorted by it, each run whole. Holds one batch and one run at a time."""
    held: list[dict[str, np.ndarray]] = []

    def whole() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([part[c] for part in held]) for c in held[0]}

    for batch in batches:
        if not len(batch):
            continue
        arrays = {c: batch[c].to_numpy() for c in batch.columns}
        values = arrays[key]
        cuts = [0, *((values[1:] != values[:-1]).nonzero()[0] + 1).tolist(), len(values)]
        if held and held[-1][key][-1] != values[0]:
            yield whole()
            held = []
        for start, end in zip(cuts, cuts[1:]):
            if start:
                yield whole()
                held = []
            held.append({c: v[start:end] for c, v in arrays.items()})
    if held:
        yield whole()
