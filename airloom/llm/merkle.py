"""Merkle manifest of a dataset: digests are kept every few levels, proofs regenerate the levels in between."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import stored
from airloom.operators.positions import matches, numbered
from airloom.session import ensure_checkpoint_folder

FAN = 3  # nodes that become one
KEPT_EVERY = 4  # levels between stored ones: a subtree has FAN ** KEPT_EVERY entries at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WHOLE = "_whole"  # the one tree of all subroots
NODE = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row: each value with its length in bytes before it, so that no two rows read alike; null is a dash."""
    told = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told])


def _depth(count: Column) -> Column:
    """Levels above ``count`` leaves: the number of powers of ``FAN`` below it, in whole numbers."""
    powers = [FAN ** i for i in range(64) if FAN ** i < 1 << 62]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < count))


def _next_level(row: Column) -> Column:
    """Digests of every ``FAN`` consecutive ones; the last run may be shorter."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(row) / FAN).cast("int") - 1)
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(row, i * FAN + 1, F.lit(FAN)), "")))


def _subtrees(level: DataFrame, below: int, also: Sequence[str] = ()) -> DataFrame:
    """One row per aligned subtree over a stored level: its digests in order, and the levels in between.

    ``level`` has ``tree, position, depth, digest``. ``level_0`` holds the stored digests and ``level_i`` what they become
    i levels up; a tree that ends earlier stays at its root. ``entries`` carries the columns ``also``.
    """
    size = FAN ** KEPT_EVERY
    entry = F.struct("position", "digest", *also)
    made = level.groupBy("tree", "depth", F.floor(F.col("position") / size).alias("block")).agg(
        F.sort_array(F.collect_list(entry)).alias("entries"))  # at most ``size`` entries
    made = made.withColumn("steps", F.greatest(F.lit(0), F.least(F.lit(KEPT_EVERY), F.col("depth") - below)))
    made = made.withColumn("level_0", F.transform("entries", lambda e: e["digest"]))
    for i in range(KEPT_EVERY):
        made = made.withColumn(f"level_{i + 1}", F.when(F.col("steps") > i, _next_level(F.col(f"level_{i}")))
                               .otherwise(F.col(f"level_{i}")))
    return made


@dataclass
class Forest:
    """Stored levels 0, ``KEPT_EVERY``, 2 * ``KEPT_EVERY``, ... of many trees, and each tree's root."""

    levels: list[DataFrame]
    roots: DataFrame  # tree, root


def grow(leaves: DataFrame, name: str) -> Forest:
    """Trees over ``leaves`` (``tree, position, depth, digest``). Every round moves one digest per subtree upwards."""
    levels, below = [leaves], 0
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    while True:
        tops = _subtrees(levels[-1].select("tree", "position", "depth", "digest"), below)
        top = stored(tops.select("tree", F.col("block").alias("position"), "depth",
                                 F.col(f"level_{KEPT_EVERY}")[0].alias("digest")), f"merkle-{name}")
        below += KEPT_EVERY
        if deepest <= below:
            return Forest(levels, top.select("tree", F.col("digest").alias("root")))
        levels.append(top)


def _siblings(index: Column, row: Column) -> Column:
    """The others of an entry's run, those before and those after it, each joined."""
    first = F.floor(index / FAN).cast("int") * FAN
    return F.struct(F.array_join(F.slice(row, first + 1, index - first), "").alias("left"),
                    F.array_join(F.slice(row, index + 2, first + FAN - 1 - index), "").alias("right"))


def paths(forest: Forest, above: DataFrame, also: Sequence[str] = (), only: DataFrame | None = None) -> DataFrame:
    """``tree, position, digest, path`` and the columns ``also`` of every leaf; ``path`` lists its siblings upwards.

    ``above`` (``tree, path``) tells how each tree's root goes on; its other columns are handed on to the leaves. From the top stored level to the leaves, each subtree
    is regenerated from its stored digests in one task, hands the siblings of all its entries on and is dropped.
    What is joined on the way is one row per subtree, never one per leaf. With ``only`` (``tree, position``) no more
    than the subtrees above these leaves are regenerated.
    """
    size, upper = FAN ** KEPT_EVERY, None
    carried = [c for c in above.columns if c not in ("tree", "path")]
    for number in reversed(range(len(forest.levels))):
        own, below = list(also) if not number else [], number * KEPT_EVERY
        level = forest.levels[number].select("tree", "position", "depth", "digest", *own)
        if only is not None:
            span = size ** (number + 1)  # leaves below one subtree
            need = only.select("tree", F.floor(F.col("position") / span).alias("block")).distinct()
            level = level.join(need, matches(level, need, ["tree"])
                               & (F.floor(level["position"] / size) == need["block"]), "left_semi")
        made = _subtrees(level, below, own)
        if upper is None:  # the top level has one subtree in each tree
            joined = made.join(above, matches(made, above, ["tree"]))
        else:
            joined = made.join(upper, matches(made, upper, ["tree"]) & (made["block"] == upper["position"]))
        going_on = above if upper is None else upper
        joined = joined.select(made["*"], going_on["path"].alias("rest"), *[going_on[c] for c in carried])

        def proved(entry: Column, at: Column) -> Column:
            inside = F.array(*[F.when(F.col("steps") > i, _siblings(F.floor(at / FAN ** i).cast("int"), F.col(f"level_{i}")))
                               for i in range(KEPT_EVERY)])
            return F.struct(*[entry[c].alias(c) for c in ("position", "digest", *own)],
                            F.concat(F.filter(inside, lambda x: x.isNotNull()), F.col("rest")).alias("path"))

        upper = joined.select("tree", *carried, F.explode(F.transform("entries", proved)).alias("entry")).select(
            "tree", "entry.*", *carried)
    if only is not None:
        upper = upper.join(only, matches(upper, only, ["tree", "position"]), "left_semi")
    return upper


def folded(path: Column, start: Column) -> Column:
    """The root that ``start`` leads to with the siblings of ``path``."""
    return F.aggregate(path, start, lambda done, s: digest(s["left"], done, s["right"]))


def path_digest(path: Column) -> Column:
    """Digest of all siblings of ``path``, level by level from the leaf, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


@dataclass
class Manifest:
    """A tree for each value of the tree column over its rows' leaves, and one over their roots, all in the shared folder.

    ``leaves`` also holds ``key``, the row's order column, and the columns named in ``also``.
    """

    leaves: Forest
    whole: Forest
    also: tuple[str, ...]

    def subroots(self) -> DataFrame:
        """``tree, subroot, position`` of every tree, null first, then by bytes."""
        own = self.whole.levels[0]
        return own.select(F.col("key").alias("tree"), F.col("digest").alias("subroot"), "position")

    def root(self) -> str | None:
        """The digest of everything; None for a table without rows."""
        row = self.whole.roots.first()
        return row["root"] if row else None

    def proofs(self, only: DataFrame | None = None) -> DataFrame:
        """``tree, position, key, leaf, path, subroot, root`` and the manifest's own columns, for every row.

        With ``only`` (``tree, position``) for these rows alone.
        """
        end = self.whole.roots.select("tree", F.array().cast(f"array<{NODE}>").alias("path"), "root")
        # One row per tree: what every proof of the tree ends with.
        tops = stored(paths(self.whole, end, ["key"]).select(
            F.col("key").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "merkle-tops")
        made = paths(self.leaves, tops, ["key", *self.also], only)
        return made.select("tree", "position", "key", F.col("digest").alias("leaf"), "path", "subroot", "root", *self.also)


def build_manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "source", key: str = "doc_id",
                   also: dict[str, Column] | None = None) -> Manifest:
    """Manifest of ``rows``: a leaf per row over ``fields`` in this order, a tree per value of ``tree`` ordered by ``key``.

    While a tree has several nodes, every three consecutive ones become their digest (the last run has fewer, even
    one); a lone leaf is its own root. The trees' roots, ordered by ``tree`` (null first, then bytewise), likewise
    lead to the root. Null is a value of its own in every column. Rows of equal key are ordered by their leaves, and
    rows that repeat wholly give equal leaves side by side. Other columns do not count; ``also`` adds expressions to
    each leaf. No rows give no leaves, no trees and no root. Texts are hashed where they lie and never moved.

    Places come from range partitions, so a tree of any size is numbered, hashed and proved in pieces of
    ``FAN ** KEPT_EVERY`` entries.
    """
    ensure_checkpoint_folder(rows.sparkSession)
    extra = also or {}
    made = stored(rows.select(F.col(tree).cast("string").alias("tree"), F.col(key).alias("key"),
                              leaf([F.col(f) for f in fields]).alias("digest"),
                              *[c.alias(n) for n, c in extra.items()]), "merkle-rows")
    leaves = numbered(made, ["tree"], [F.col("key").asc_nulls_first(), "digest"], total="held")
    leaves = stored(leaves.withColumn("depth", _depth(F.col("held"))).drop("held"), "merkle-leaves")
    forest = grow(leaves, "trees")
    roots = forest.roots.select(F.lit(WHOLE).alias("tree"), F.col("tree").alias("key"), F.col("root").alias("digest"))
    tops = numbered(roots, ["tree"], [F.col("key").asc_nulls_first()], total="held")
    tops = stored(tops.withColumn("depth", _depth(F.col("held"))).drop("held"), "merkle-subroots")
    return Manifest(forest, grow(tops, "whole"), tuple(extra))


def verify(proved: DataFrame, leaf_column: str) -> DataFrame:
    """``proved`` with ``folded_root``, what ``leaf_column`` leads to, and ``verified``: whether that is the root."""
    made = proved.withColumn("folded_root", folded(F.col("path"), F.col(leaf_column)))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))
