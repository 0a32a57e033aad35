"""Exact deduplication over an extendible-hash index in the shared folder. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from airloom.llm.common import chosen, stored, texts

CAPACITY = 100_000
MAX_BITS = 16
HOT_ROWS, HOT_SHARE = 1_000, 10_000


def directory(entries: DataFrame, capacity: int = CAPACITY, max_bits: int = MAX_BITS) -> DataFrame:
    """The directory over the leading bits of ``key``: ``cell``, ``depth`` and ``bucket``, its first cell.

    It starts as one bucket. While a bucket holds more than ``capacity`` entries the directory doubles: overfull
    buckets split by one more bit, the others keep their depth. It has 2**max_bits rows at most; a bucket
    still overfull there stays whole and its collisions are chained.
    """
    cells = stored(entries.groupBy(F.shiftrightunsigned("key", 64 - max_bits).cast("int").alias("cell"))
                   .agg(F.count("*").alias("n")), "exact-cells")
    depth = 0
    while depth < max_bits:
        fullest = cells.groupBy(F.shiftright("cell", max_bits - depth)).agg(F.sum("n").alias("held"))
        if (fullest.agg(F.max("held")).first()[0] or 0) <= capacity:
            break
        depth += 1
    local = F.lit(depth)
    for bits in reversed(range(depth)):
        held = F.sum("n").over(W.partitionBy(F.shiftright("cell", max_bits - bits)))
        local = F.when(held <= capacity, bits).otherwise(local)
    spare = f"cast({max_bits} - depth as int)"
    return cells.select("cell", local.alias("depth")).select(
        "cell", "depth", F.expr(f"shiftleft(shiftright(cell, {spare}), {spare})").alias("bucket"))


def _bucket_of(cells: DataFrame, rows: DataFrame, max_bits: int) -> DataFrame:
    """``rows`` with the bucket and depth that the directory gives their keys."""
    cell = F.shiftrightunsigned("key", 64 - max_bits).cast("int")
    return rows.join(F.broadcast(cells), cell == F.col("cell")).drop("cell")  # 2**max_bits rows at most


def probes(docs: DataFrame) -> DataFrame:
    """``doc_id, key, text_sha256, place`` of every row, without its text: what is looked up in the index."""
    return stored(texts(docs).select("doc_id", F.xxhash64("text").alias("key"),
                                     F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
                                     F.monotonically_increasing_id().alias("place")), "exact-probes")


def build_index(docs: DataFrame, rows: DataFrame, capacity: int = CAPACITY, max_bits: int = MAX_BITS,
                hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """The directory, and the index it leads to: one entry per distinct text in files that owner tasks write.

    The directory is made of the distinct keys (XXH64 of the text) that ``rows`` counts. It sends every text to its bucket;
    owner tasks take ranges of buckets and keys, compare the bytes of texts with one key, add equal ones up and chain the
    others. Texts whose key more than ``hot_rows`` rows share, and more than one row in ``HOT_SHARE``, are counted
    beforehand, per task and then per text, so a hot key sends its owner one entry and not its rows.

    An entry has ``bucket, depth, key, chain`` (its place among texts with that key), ``text_sha256``, ``keep_id`` (largest
    doc_id) and ``group_size``.
    """
    keys = stored(rows.groupBy("key").agg(F.count("*").alias("n")), "exact-keys")
    cells = stored(directory(keys, capacity, max_bits), "exact-directory")
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = keys.where(F.col("n") > max(hot_rows, total // HOT_SHARE)).select("key", F.lit(True).alias("hot"))  # HOT_SHARE at most
    arriving = texts(docs).select("doc_id", "text", F.xxhash64("text").alias("key")).join(F.broadcast(hot), "key", "left")
    cold = arriving.where("hot is null").select("key", "text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    counted = arriving.where("hot").groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    owned = _bucket_of(cells, cold.unionByName(counted), max_bits).repartitionByRange("bucket", "key")
    # Grouping and chaining need no further exchange: all of a bucket's key lies with its owner.
    equal = owned.groupBy("bucket", "key", "depth", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    entries = equal.select("bucket", "depth", "key", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
                           "keep_id", "group_size")
    chained = entries.withColumn("chain", F.row_number().over(W.partitionBy("bucket", "key").orderBy("text_sha256")) - 1)
    return cells, stored(chained.sortWithinPartitions("bucket", "key", "chain"), "exact-index")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, max_bits: int = MAX_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Which of equal texts stays: ``doc_id, keep_id, group_size, kept, text_sha256, bucket, chain``.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Texts are equal when identical byte by byte;
    a null text is empty, and empty texts are equal. The largest doc_id stays; a null id is smaller than
    any other. Every row gives a row. Rows that repeat both id and text count in ``group_size``, and one of
    them only is kept. No rows give no rows. Every row is looked up in the bucket that the directory names.
    """
    rows = probes(docs)
    cells, index = build_index(docs, rows, capacity, max_bits, hot_rows)
    found = stored(_bucket_of(cells, rows, max_bits).drop("depth").join(index, ["bucket", "key", "text_sha256"]), "exact-found")
    # Usually one row per text has the id that stays. Of several the first one is kept; its place is its own.
    first = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("bucket", "key", "chain").agg(F.min("place").alias("place"))
    marked = found.join(first.select("place", F.lit(True).alias("first")), "place", "left")
    return marked.select("doc_id", "keep_id", "group_size", F.coalesce("first", F.lit(False)).alias("kept"), "text_sha256",
                         "bucket", "chain")


def drop_copies(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    kept = exact_dedup(docs, **settings).where("kept").select("doc_id", F.col("text_sha256").alias("sha"))
    return chosen(docs, kept)
