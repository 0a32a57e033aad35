"""SimHash near-duplicates: exact comparison of fingerprint tiles with exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from airloom.llm.common import chosen, groups, stored, text_digest, texts, words_of
from airloom.llm.components import components, local_roots

SHINGLE = 3
RADIUS = 2
TILE = 256
SEED = 42
PIECE = 65_536  # shingles whose bits are counted at once, so that a long text needs no more memory


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; zero without words."""
    words = words_of(text)
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[end + 1 for end in ends[:-1]]]
    spans = list(zip(starts, ends[shingle - 1:])) or [(0, len(joined))]
    ones, digest, view = np.zeros(64, np.int64), xxhash.xxh64_intdigest, memoryview(joined)
    for first in range(0, len(spans), PIECE):
        hashes = np.fromiter((digest(view[a:b], SEED) for a, b in spans[first:first + PIECE]), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(spans), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``sha`` (of the text) and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "sha": batch["sha"], "fp": made.view(np.int64)})

    whole = texts(docs)
    return whole.withColumn("sha", text_digest(whole)).mapInPandas(run, "doc_id long, sha string, fp long")


def _close(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)


def tile_links(batches: Iterator[pd.DataFrame], radius: int = RADIUS) -> Iterator[pd.DataFrame]:
    """Links within each pair of tiles, as stars: each fingerprint with the first of its component there.

    A star has the same components as all its pairs, so a large group of copies costs one row per member.
    """
    for group in groups(batches, "task"):
        fp, second = group["fp"].view(np.uint64), group["second"].astype(bool)
        if second.any():
            left, right = np.flatnonzero(~second), np.flatnonzero(second)
        else:
            left = right = np.arange(len(fp))
        i, j = _close(fp[left], fp[right], radius)
        i, j = left[i], right[j]
        root = local_roots(len(fp), i, j)
        tied = np.flatnonzero(root != np.arange(len(fp)))
        if len(tied):
            yield pd.DataFrame({"u": group["fp"][tied], "v": group["fp"][root[tied]]})


def _block(number: int, radius: int) -> Column:
    """Block ``number`` of radius + 1 blocks of the fingerprint's bits."""
    low, high = 64 * number // (radius + 1), 64 * (number + 1) // (radius + 1)
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def tile_tasks(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``task, fp, second``: which fingerprints meet in which tile pair.

    Fingerprints that differ in ``radius`` bits at most agree on one of ``radius + 1`` blocks at least, so tiles
    are formed inside equal blocks and no link is lost. Inside a block value tiles follow the bit count,
    and tile pairs whose bit counts lie further apart than the radius are left out. A block value of any size
    is cut into tiles of about ``tile``; none of them is ever one task's alone.
    """
    spread = prints.select("fp", F.bit_count("fp").alias("bits"), F.explode(F.array(*[
        F.struct(F.lit(b).alias("block"), _block(b, radius).alias("value")) for b in range(radius + 1)])).alias("at")
    ).select("fp", "bits", "at.block", "at.value")
    # At most 65 bit counts per block value: the window below stays small whatever the block value holds.
    cells = spread.groupBy("block", "value", "bits").agg(F.count("*").alias("n"))
    cell = W.partitionBy("block", "value")
    cells = stored(cells.withColumn("total", F.sum("n").over(cell))
                   .withColumn("before", F.sum("n").over(cell.orderBy("bits")) - F.col("n")).where("total > 1"),
                   "simhash-cells")
    place = F.col("before") + F.pmod(F.xxhash64("fp"), F.col("n"))
    tiled = stored(spread.join(cells, ["block", "value", "bits"])
                   .select("fp", "bits", "block", "value", F.floor(place / tile).alias("tile")), "simhash-tiles")
    tiles = tiled.groupBy("block", "value", "tile").agg(F.min("bits").alias("low"), F.max("bits").alias("high"))
    one, two = tiles.alias("one"), tiles.alias("two")
    pairs = one.join(two, (F.col("one.block") == F.col("two.block")) & (F.col("one.value") == F.col("two.value"))
                     & (F.col("one.tile") <= F.col("two.tile")) & (F.col("two.low") - F.col("one.high") <= radius))
    pairs = stored(pairs.select("one.block", "one.value", F.col("one.tile").alias("a"), F.col("two.tile").alias("b")),
                   "simhash-pairs")
    task = F.xxhash64("block", "value", "a", "b").alias("task")
    first = tiled.join(pairs.withColumn("tile", F.col("a")), ["block", "value", "tile"])
    other = tiled.join(pairs.where("a <> b").withColumn("tile", F.col("b")), ["block", "value", "tile"])
    return (first.select(task, "fp", F.lit(False).alias("second"))
            .union(other.select(task, "fp", F.lit(True).alias("second"))))


def linked(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``fp, root``: for every fingerprint of ``prints`` one that stands for its component."""
    distinct = stored(prints.select("fp").distinct(), "simhash-distinct")
    tasks = tile_tasks(distinct, radius, tile)
    links = (tasks.repartition("task").sortWithinPartitions("task")
             .mapInPandas(lambda batches: tile_links(batches, radius), "u long, v long"))
    found = components(links, "simhash-links")
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (``doc_id``, ``text``; others are ignored).

    Fingerprints at ``radius`` or fewer differing bits are linked; ``component_id`` is the smallest doc_id reachable.
    A null text is empty; texts without words have fingerprint zero and are linked like any other. Repeated rows
    give repeated rows. Rows without doc_id keep their row and lend no id: a component of such rows only
    has none. No rows give no rows.
    """
    prints = stored(fingerprints(docs, shingle), "simhash-prints")
    tied = linked(prints, radius, tile)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = tied.join(first, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = tied.join(roots, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row of ``docs`` for each component of linked fingerprints, with all its columns.

    The row with the smallest doc_id stays, one without id only where none of its component has one. Of rows that share the
    id, the text whose SHA-256 is smallest stays; of rows equal in id and text, one.
    """
    prints = stored(fingerprints(docs, shingle), "simhash-prints")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "sha")
    # A candidate per fingerprint, found per task first; then one per component.
    first = prints.groupBy("fp").agg(F.min(row).alias("row"))
    leaders = linked(prints, radius, tile).join(first, "fp").groupBy("root").agg(F.min("row").alias("row"))
    return chosen(docs, leaders.select("row.doc_id", "row.sha")).select(docs.columns)
