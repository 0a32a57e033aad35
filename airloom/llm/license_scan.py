"""License scans: MinHash bands over overlapping windows find templates, shingle containment confirms. DataFrame only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm.common import LOWER, UPPER, stored

SHINGLE = 5
CONTAINED = 0.8
BANDS = 32
MOST_TEMPLATE_SHINGLES = 1_000_000  # of all templates together: what may be broadcast

# Notices by which works state their license.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                      "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                      "provided that the following conditions are met:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES.items()), "template_id string, text string")


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words, A-Z lower-cased, in order; none in a text of fewer words."""
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))

    # The one-element array binds the words to a name: written out twice, they would be split for every run again.
    return F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) >= size, runs(w))), 1)


def _bands(bands: int) -> list[Column]:
    return [F.min(F.xxhash64("shingle", F.lit(k))).alias(f"b{k}") for k in range(bands)]


def _unpivoted(df: DataFrame, keys: list[str], bands: int) -> DataFrame:
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col(f"b{k}").alias("low")) for k in range(bands)]))
    return df.select(*keys, at.alias("at")).select(*keys, "at.band", "at.low")


def scan_licenses(docs: DataFrame, templates: DataFrame, size: int = SHINGLE, contained: float = CONTAINED,
                  bands: int = BANDS) -> DataFrame:
    """``doc_id, template_id, containment, first_word, last_word`` for every document and template found in it.

    ``docs`` has ``doc_id`` and ``text``, ``templates`` ``template_id`` and ``text``; other columns are ignored. A
    template is found where a window holds ``contained`` or more of its distinct word shingles; the best window
    is told, the first of equal ones, with the places of its first and last matching word. Null and empty
    texts, and texts or templates shorter than a shingle, find nothing. Ids may be null or repeat: every row of
    ``docs`` is scanned by itself. Templates of one id are one template. No rows give no rows.

    A template of n shingles is looked for in windows of W shingles, W being the power of two from 2n on, that start
    every W/2: each place of n shingles lies wholly in one of them. The Jaccard similarity is then 0.19 or more, so
    of 32 bands of one MinHash each none collides with a probability under 0.2 %. Shingles of no template
    add nothing to a containment and are left out before windows are formed, which raises it further.
    """
    split = templates.select("template_id", F.explode(shingles(F.col("text").cast("string"), size)).alias("shingle"))
    known = stored(split.where("shingle is not null and template_id is not null").distinct(), "license-shingles")
    count = known.count()
    if count > MOST_TEMPLATE_SHINGLES:
        raise ValueError(f"templates have {count} shingles, more than {MOST_TEMPLATE_SHINGLES}")
    sizes = known.groupBy("template_id").agg(F.count("*").alias("n"), *_bands(bands)).withColumn(
        "width", F.pow(F.lit(2), F.ceil(F.log2(2 * F.col("n")))).cast("long"))
    sizes = stored(sizes, "license-templates")
    widths = [r["width"] for r in sizes.select("width").distinct().collect()]  # powers of two up to the bound above

    # Only shingles of some template go on; the set of them is bounded above and is held by every task.
    vocabulary = F.broadcast(known.select("shingle").distinct())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    places = rows.withColumn("row", F.monotonically_increasing_id()).select(
        "doc_id", "row", F.posexplode(shingles(F.col("text"), size)).alias("at", "shingle"))
    hits = stored(places.join(vocabulary, "shingle", "left_semi"), "license-hits")

    window = F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("width"), (F.floor(F.col("at") / (w // 2)) - back).alias("window"))
                                 for w in widths for back in (0, 1)])) if widths else F.explode(F.expr(
        "cast(array() as array<struct<width: bigint, window: bigint>>)"))
    placed = stored(hits.select("row", "doc_id", "at", "shingle", window.alias("w")).select(
        "row", "doc_id", "at", "shingle", "w.width", "w.window"), "license-windows")
    signed = placed.groupBy("row", "width", "window").agg(*_bands(bands))
    asked = F.broadcast(_unpivoted(sizes, ["template_id", "width", "n"], bands))  # ``bands`` rows per template
    candidates = (_unpivoted(signed, ["row", "width", "window"], bands).join(asked, ["width", "band", "low"])
                  .select("row", "width", "window", "template_id", "n").distinct())
    met = placed.join(candidates, ["row", "width", "window"]).join(F.broadcast(known), ["template_id", "shingle"])
    share = F.count_distinct("shingle") / F.first("n")
    confirmed = met.groupBy("row", "doc_id", "template_id", "width", "window").agg(
        share.alias("containment"), F.min("at").alias("first_word"), (F.max("at") + size - 1).alias("last_word"))
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("early"), (-F.col("last_word")).alias("short")))
    return (confirmed.where(F.col("containment") >= contained).groupBy("row", "doc_id", "template_id").agg(best.alias("best"))
            .select("doc_id", "template_id", F.col("best.containment").alias("containment"),
                    (-F.col("best.early")).cast("long").alias("first_word"), (-F.col("best.short")).cast("long").alias("last_word")))
