"""Near copies by exact Jaccard similarity of word shingles: prefix filter, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from airloom.llm.common import groups, stored, texts, words_of
from airloom.llm.components import components

SHINGLE = 5
LIKE = (4, 5)  # similarity as a fraction, so that sizes are compared in whole numbers
SEED = 42
SAMPLE = 20_000  # texts in which common shingles are looked for
COMMON, MOST_COMMON = 10, 200_000  # texts of the sample a common shingle is in; how many such shingles are told
MOST_BROADCAST = 2_000_000  # ids
PIECE = 1 << 20  # pairs of one shingle compared at once


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``shingle`` words; a text of fewer words is one run."""
    words = words_of(text)
    joined, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[end + 1 for end in ends[:-1]]]
    spans = list(zip(starts, ends[shingle - 1:])) or [(0, len(joined))]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.unique(np.fromiter((digest(view[a:b], SEED) for a, b in spans), np.uint64, len(spans)))


def alike(one: np.ndarray, two: np.ndarray, like: tuple[int, int] = LIKE) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both * like[1] >= like[0] * (len(one) + len(two) - both)


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample share, sorted, and how many share each.

    They only set the order in which shingles are looked at: any order finds the same pairs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"token": shingle_set(text, shingle).view(np.int64)})

    nth = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(nth)) == 0)
    made = (sample.mapInPandas(run, "token long").groupBy("token").count().where(F.col("count") >= COMMON)
            .orderBy(F.desc("count"), "token").limit(MOST_COMMON).toPandas())
    token, n = made["token"].to_numpy(np.int64).view(np.uint64), made["count"].to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], n[order]


def prefix(tokens: np.ndarray, common: np.ndarray, shared: np.ndarray, like: tuple[int, int] = LIKE) -> np.ndarray:
    """The first shingles of a set, rarest first, one of which every set as similar as ``like`` has in its prefix too."""
    n = len(tokens)
    held = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        held = np.where(common[at] == tokens, shared[at], 0)
    return tokens[np.lexsort((tokens, held))][:n - -(-n * like[0] // like[1]) + 1]


def _entries(docs: DataFrame, shingle: int, like: tuple[int, int]) -> DataFrame:
    told = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                tokens = shingle_set(text, shingle)
                first = prefix(tokens, *told.value, like)
                yield pd.DataFrame({"token": first.view(np.int64), "doc_id": doc, "n": len(tokens), "at": np.arange(len(first))})

    return docs.mapInPandas(run, "token long, doc_id long, n int, at int")


def _possible(n, at, other_n, other_at, like: tuple[int, int]):
    """Whether sets of these sizes can be alike if the shingle at these places is the first they share; n <= other_n."""
    return n * like[1] >= other_n * like[0], n - at, other_n - other_at, (n + other_n) * like[0]


def _other_pairs(batches: Iterator[pd.DataFrame], like: tuple[int, int]) -> Iterator[pd.DataFrame]:
    """Pairs of texts of different components that share a shingle and can be alike, a bounded number at a time."""
    for group in groups(batches, "token"):
        doc, root, n, at = (group[c].astype(np.int64) for c in ("doc_id", "root", "n", "at"))
        last = np.searchsorted(n, n * like[1] // like[0], side="right")  # by size, rising
        step = max(1, PIECE // len(doc))
        for low in range(0, len(doc), step):
            high = min(low + step, len(doc))
            j = np.arange(low + 1, max(int(last[high - 1]), low + 1))
            i = np.arange(low, high)[:, None]
            fits, rest, other, need = _possible(n[i], at[i], n[j], at[j], like)
            left, right = np.nonzero((i < j) & (root[i] != root[j]) & fits
                                     & (np.minimum(rest, other) * sum(like) >= need))
            if len(left):
                a, b = doc[low + left], doc[j[right]]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, like: tuple[int, int]) -> DataFrame:
    """``u, v``: the pairs whose whole texts are alike."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "near-ids")
    asked = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    some = stored(docs.join(asked, "doc_id", "left_semi"), "near-texts")
    one, two = some.select(F.col("doc_id").alias("a"), F.col("text").alias("one")), some.select(
        F.col("doc_id").alias("b"), F.col("text").alias("two"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [alike(shingle_set(x, shingle), shingle_set(y, shingle), like) for x, y in zip(batch["one"], batch["two"])]
            yield batch.loc[keep, ["a", "b"]].rename(columns={"a": "u", "b": "v"})

    return pairs.join(one, "a").join(two, "b").mapInPandas(run, "u long, v long")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, like: tuple[int, int] = LIKE) -> DataFrame:
    """``node, root``: every doc_id with a near copy, and the smallest doc_id it is linked with, itself included.

    Texts are linked if the Jaccard similarity of their sets of word shingles is ``like`` (4, 5) = 0.8 or more. No such
    pair is missed: in any order of all shingles, two such sets share one among the first n - ceil(0.8 n) + 1 of
    each. The order puts shingles rarest first, so few texts meet. Of the texts that meet at a shingle neighbours in
    size are checked first; those they link need no further check among themselves, so a large group of copies
    costs a few checks per member. All other pairs that meet and whose sizes and places allow 0.8 are checked.
    A null text is empty; empty texts are alike. Rows without doc_id are left out; rows of one doc_id are one document.
    """
    known = texts(docs).where("doc_id is not null")
    size = W.partitionBy("token").orderBy("n", "doc_id", "at")
    before = F.lag(F.struct("doc_id", "n", "at")).over(size)
    met = stored(_entries(known, shingle, like).select("*", before.alias("before"), F.lead("doc_id").over(size).alias("after"))
                 .where("before is not null or after is not null").drop("after"), "near-entries")

    fits, rest, other, need = _possible(F.col("before.n"), F.col("before.at"), F.col("n"), F.col("at"), like)
    next_to = met.where((F.col("before.doc_id") != F.col("doc_id")) & fits & (F.least(rest, other) * sum(like) >= need))
    first = stored(next_to.select(F.least("doc_id", "before.doc_id").alias("a"), F.greatest("doc_id", "before.doc_id").alias("b"))
                   .distinct(), "near-pairs")
    links = stored(_confirmed(first, known, shingle, like), "near-links")

    found = components(links, "near-components")
    every = W.partitionBy("token")
    open_ = (met.drop("before").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
             .withColumn("root", F.coalesce("root", "doc_id"))
             .withColumns({"low": F.min("root").over(every), "high": F.max("root").over(every), "size": F.count("*").over(every)})
             .where("low < high and size > 2").select("token", "doc_id", "root", "n", "at"))  # pairs were checked above
    pairs = (open_.repartition("token").sortWithinPartitions("token", "n", "doc_id")
             .mapInPandas(lambda batches: _other_pairs(batches, like), "a long, b long").distinct())
    more = _confirmed(stored(pairs.join(first, ["a", "b"], "left_anti"), "near-pairs"), known, shingle, like)
    return components(links.union(more), "near-components")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, like: tuple[int, int] = LIKE) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group of near copies, one row for each id.

    Rows that repeat a doc_id are one document. Rows without one all stay.
    """
    others = near_copies(docs, shingle, like).where("node <> root").select(F.col("node").alias("doc_id"))
    return docs.join(others, "doc_id", "left_anti").where("doc_id is not null").dropDuplicates(["doc_id"]).select(
        docs.columns).union(docs.where("doc_id is null"))
