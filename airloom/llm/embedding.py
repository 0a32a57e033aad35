"""Near-duplicate vectors: rotated binary codes, multi-index Hamming tables, exact cosine on what they retrieve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import groups, stored
from airloom.llm.components import components, local_roots

SAMPLE = 20_000  # vectors that the rotations are fitted on, those of smallest id hash
ROUNDS = 30
ROTATIONS = 2
KEY_BITS = 16  # of one table's key
TILE = 256
LIMIT = 0.98
SEED = 5


def fit_rotations(sample: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean and projections of iterative quantisation: main axes, then a rotation towards the corners of the cube.

    Each round takes the signs as codes and the rotation that brings the projected vectors nearest to them, found
    by a singular value decomposition. Every start gives another set of codes.
    """
    mean = sample.mean(0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    projected = centred @ axes.T
    made = []
    for start in range(ROTATIONS):
        turn, _ = np.linalg.qr(np.random.default_rng(SEED + start).normal(size=(projected.shape[1],) * 2))
        for _ in range(ROUNDS):
            codes = np.where(projected @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(projected.T @ codes)
            turn = left @ right
        made.append(axes.T @ turn)
    return mean, made


def _units(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tile_links(batches: Iterator[pd.DataFrame], limit: float) -> Iterator[pd.DataFrame]:
    """Links inside each tile pair: per vector how many, and a star that ties it to the first of its component.

    A pair that meets in several tables counts in the first of them alone, which both codes show.
    """
    for group in groups(batches, "task"):
        units, second = _units(pd.Series(group["vector"])), group["second"].astype(bool)
        keys = np.array(group["keys"].tolist(), np.int64)
        table, times, ids = int(group["table"][0]), group["times"], group["node"]
        if group["across"][0]:
            left, right = np.flatnonzero(~second), np.flatnonzero(second)
            i, j = np.nonzero(units[left] @ units[right].T >= limit)
            i, j = left[i], right[j]
        else:
            i, j = np.nonzero(np.triu(units @ units.T >= limit, 1))
        first = ~(keys[i, :table] == keys[j, :table]).any(1)
        i, j = i[first], j[first]
        if not len(i):
            continue
        links = np.bincount(i, times[j], len(ids)) + np.bincount(j, times[i], len(ids))
        root = local_roots(len(ids), i, j)
        tied = np.flatnonzero(links)
        yield pd.DataFrame({"node": ids[tied], "root": ids[root[tied]], "links": links[tied].astype(np.int64)})


def near_vectors(vectors: DataFrame, limit: float = LIMIT, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Vectors of equal label are linked if their cosine, in double precision, is ``limit`` or more. Equal vectors of a
    label are taken together first and count with their number. Null labels, null or zero vectors and those
    with null or non-finite components link with nothing; vectors of different lengths neither.
    ``component_id`` is the smallest vec_id reachable. Rows of one vec_id are different vectors that share their
    name; a null vec_id is never a component's name while there is another. No rows give no rows.

    Tables: the sign codes of ``ROTATIONS`` rotations are cut into keys of ``KEY_BITS`` bits, one table each; two
    vectors are compared if they share a key. Tables and label form buckets, buckets of any size are cut into
    tiles, and tiles are compared in pairs. A pair just at 0.98 is retrieved with a probability of about 0.97
    for 128 bits, nearer ones almost surely.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<double>").alias("vector"))
    wide = F.lit(1e300)
    fine = (F.col("label").isNotNull() & F.col("vector").isNotNull()
            & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < wide))
            & F.exists("vector", lambda x: x != 0))
    rows = stored(rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn(
        "node", F.xxhash64("label", "vector")), "vectors")
    distinct = stored(rows.where("fine").groupBy("node", "label", "vector").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("times")).withColumn("size", F.size("vector")), "vectors-distinct")
    sizes = [r["size"] for r in distinct.select("size").distinct().limit(65).collect()]
    if len(sizes) > 64:
        raise ValueError("vectors have more than 64 different lengths")
    fitted = {}
    for size in sizes:
        sample = distinct.where(F.col("size") == size).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").toPandas()
        fitted[size] = fit_rotations(_units(sample["vector"]))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                mean, turns = fitted[size]
                units = _units(part["vector"]) - mean
                bits = np.hstack([units @ turn >= 0 for turn in turns])
                bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % KEY_BITS)))
                keys = bits.reshape(len(part), -1, KEY_BITS) @ (1 << np.arange(KEY_BITS))
                yield part.assign(keys=list(keys))

    indexed = stored(distinct.mapInPandas(coded, "node long, label string, vector array<double>, first_id long, "
                                                 "times long, size int, keys array<int>"), "vectors-coded")
    slots = indexed.select("node", F.xxhash64("label", "size").alias("class"), F.posexplode("keys").alias("table", "key"))
    buckets = stored(slots.groupBy("class", "table", "key").agg(F.count("*").alias("held")).where("held > 1"), "vector-buckets")
    # The number of tiles follows from the bucket's size; every row meets all tiles of its bucket, its own among them.
    placed = slots.join(buckets, ["class", "table", "key"]).withColumn("tiles", F.ceil(F.col("held") / tile)).withColumn(
        "own", F.pmod(F.xxhash64("node", "table"), F.col("tiles")))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tasks = met.select("node", "table", F.xxhash64(
        "class", "table", "key", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
        (F.col("own") != F.col("other")).alias("across"), (F.col("own") > F.col("other")).alias("second"))
    filled = tasks.join(indexed.select("node", "vector", "times", "keys"), "node")
    links = stored(filled.select("task", "node", "table", "across", "second", "vector", "times", "keys").repartition("task")
                   .sortWithinPartitions("task")
                   .mapInPandas(lambda batches: tile_links(batches, limit), "node long, root long, links long"), "vector-links")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")), "vector-components")
    tied = (indexed.select("node", "first_id", "times").join(counted, "node", "left").join(found, "node", "left")
            .select("node", "first_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
                    F.coalesce("root", "node").alias("root")))
    names = tied.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = tied.join(names, "root").select("node", "n_links", "component_id", F.lit(True).alias("fine"))
    joined = rows.join(classes, ["node", "fine"], "left")
    component = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
