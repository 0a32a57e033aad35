"""Documents made ready for training: five stages, each on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm import bpe, exact_dedup, mixing, quality, simhash
from airloom.llm.common import stored
from airloom.llm.queries import RANKS, TARGETS, labelled_domains, table


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of three-word shingles that differ in two bits or fewer, the one of smallest doc_id."""
    return simhash.drop_near_copies(docs)


def to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains below their target repeated by their rates; none is lost."""
    return mixing.repeat_to_targets(docs, labelled_domains(spark, sf_dir), TARGETS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, checked by decoding them again."""
    path = public_tokenizers.path(RANKS)
    coded = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", accept_quality), ("exact dedup", one_of_equal), ("SimHash near-dedup", one_of_near),
          ("mixing to target weights", to_targets), ("byte-level BPE", token_ids)]
ORACLE_SQL = None  # the classifier and the rates are fitted, which SQL cannot express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
