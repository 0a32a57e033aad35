"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import remainder, stored, texts, words_of

END, START = b"", b" "  # no word is empty or holds a space
BITS = 10  # of the filter per event
PROBES = 4  # bits set per event
MOST_BYTES = 1 << 30  # of the broadcast filter; beyond it false positives rise and ``false_positive`` tells how far
SHARD_TOKENS = 1_000_000  # training tokens per shard of the filter, at least LEAST_SHARDS shards
LEAST_SHARDS = 64
PRIOR = 50.0  # weight of the one-word model against the counts of a history
COMMON = 1 << 17  # tokens whose exact counts are broadcast; the counts of all others are joined
PART = 1_000  # documents handled at once
HELD = 400_000  # distinct tokens counted in memory before they are handed on

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit keys of word pairs from the words' hashes; single words are their own keys."""
    return _mix(before * _A + _mix(word))


class Places(dict):
    """Numbers words in the order they are first asked for; START has place 0."""

    def __init__(self):
        super().__init__({START: 0})

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


def _indexed(parts: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, and for every token its word's place and the place of the word before it.

    Each text ends with END and its first token follows START.
    """
    places, words, before = Places(), [], []
    for tokens in parts:
        at = np.fromiter(map(places.__getitem__, [START, *tokens, END]), np.int32, len(tokens) + 2)
        words.append(at[1:])
        before.append(at[:-1])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, places), np.uint64, len(places))
    return hashes, np.concatenate(words), np.concatenate(before)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for first in range(0, len(batch), PART):
            yield batch.iloc[first:first + PART]


def count_tokens(train: DataFrame) -> DataFrame:
    """``token, n`` over all texts, END among them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"token": list(held), "n": list(held.values())})

        for part in _parts(batches):
            for text in part["text"]:
                held.update(words_of(text))
            held[END] += len(part)
            if len(held) > HELD:
                yield rows()
                held.clear()
        yield rows()

    return train.mapInPandas(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def common_counts(counts: DataFrame, most: int = COMMON) -> dict[bytes, int]:
    """Exact counts of the most frequent tokens, ``most`` of them or fewer.

    Tokens are counted by eighths of powers of two of their frequency; the cut lies between two of these classes.
    """
    rank = F.floor(F.log2("n") * 8).cast("int")
    classes = counts.groupBy(rank.alias("rank")).agg(F.count("*").alias("tokens")).orderBy(F.desc("rank")).collect()
    taken, cut = 0, None  # at most 8 * 63 classes
    for c in classes:
        taken += c["tokens"]
        if taken > most:
            break
        cut = c["rank"]
    if cut is None:
        return {}
    return {bytes(r["token"]): r["n"] for r in counts.where(rank >= cut).toLocalIterator()}


@dataclass
class CountFilter:
    """Bits of all shards end to end. A count c is held as levels 1 to 1 + floor(log2 c) of its key."""

    bits: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        shard = (keys % np.uint64(len(self.sizes))).astype(np.int64)
        found = np.ones(len(keys), bool)
        for at in _positions(keys, level, self.sizes[shard]):
            at = at.astype(np.int64) + self.starts[shard]
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Expected counts: levels are probed upwards until one is missing."""
        level, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
        while len(open_):
            open_ = open_[self.has(keys[open_], int(level[open_[0]]) + 1)]
            level[open_] += 1
        return np.where(level > 1, 0.75 * 2.0 ** level - 0.5, level)  # middle of 2**(level-1) to 2**level - 1


def _positions(keys: np.ndarray, level: int | np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    x = _mix(keys + np.asarray(level).astype(np.uint64) * _B)
    low, high = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (low + np.uint64(i) * high) % sizes.astype(np.uint64)


def _shard_bits(keys: np.ndarray, counts: np.ndarray, most_bits: int) -> tuple[np.ndarray, int]:
    """Packed bits of one shard and its number of events."""
    levels = np.floor(np.log2(counts)).astype(np.int64) + 1
    events = int(levels.sum())
    size = max(64, min(events * BITS, most_bits) // 8 * 8)
    flags = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= level]
        for at in _positions(own, level, np.full(len(own), size)):
            flags[at.astype(np.int64)] = True
    return np.packbits(flags, bitorder="little"), events


def build_filter(train: DataFrame, tokens: int, most_bytes: int = MOST_BYTES) -> tuple[CountFilter, float]:
    """The filter of all words and word pairs of ``train``, and its estimated rate of false positives.

    Pairs are counted per task, packed per shard of the key space, and each shard sets its own bits. The driver gets
    the bits alone, ``most_bytes`` at most.
    """
    shards = max(LEAST_SHARDS, math.ceil(tokens / SHARD_TOKENS))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches):
            hashes, word, before = _indexed(words_of(t) for t in part["text"])
            single = np.bincount(word, minlength=len(hashes))
            single[0] = len(part)
            pairs, n = np.unique(pair_keys(hashes[before], hashes[word]), return_counts=True)
            keys, n = np.concatenate([hashes, pairs]), np.concatenate([single, n]).astype(np.int32)
            shard = (keys % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            cuts = np.cumsum(np.bincount(shard, minlength=shards))[:-1]
            yield pd.DataFrame({"shard": np.arange(shards, dtype=np.int32),
                                "keys": [k.tobytes() for k in np.split(keys[order], cuts)],
                                "n": [c.tobytes() for c in np.split(n[order], cuts)]})

    most_bits = most_bytes * 8 // shards

    def filled(rows: pd.DataFrame) -> pd.DataFrame:
        keys, at = np.unique(np.frombuffer(b"".join(rows["keys"]), np.uint64), return_inverse=True)
        bits, events = _shard_bits(keys, np.bincount(at, np.frombuffer(b"".join(rows["n"]), np.int32)), most_bits)
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "events": [events], "bits": [bits.tobytes()]})

    made = stored(train.mapInPandas(counted, "shard int, keys binary, n binary").groupBy("shard")
                  .applyInPandas(filled, "shard int, events long, bits binary"), "lm-filter")
    empty = np.zeros(8, np.uint8)
    parts, events = [empty] * shards, 0
    for row in made.toLocalIterator():
        parts[row["shard"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
        events += row["events"]
    sizes = np.array([8 * len(p) for p in parts], np.int64)
    error = (1 - math.exp(-PROBES * events / sizes.sum())) ** PROBES
    return CountFilter(np.concatenate(parts), np.cumsum(sizes) - sizes, sizes), error


def score_texts(docs: DataFrame, modulus: int = 7, held_out: int = 2, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, false_positive`` for every row.

    Learns from the rows whose crc32(doc_id) modulo ``modulus`` is not ``held_out``. ``base_score`` sums the log10
    of the add-one share of each token, from exact counts. ``score`` is the log10 probability of the text under
    word pairs: (c(before, word) + PRIOR * p(word)) / (c(before) + PRIOR) with p(word) the add-one share, all
    counts c being read from the filter. A null text is empty and has the end token alone. Null ids are not
    held out; repeated rows give repeated rows and count repeatedly. No rows give none.
    """
    rows = texts(docs).withColumn("held_out", remainder(F.col("doc_id"), modulus) == held_out)
    train = rows.where("not held_out").select("text")
    counts = stored(count_tokens(train), "lm-tokens")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, room = total["n"], float(max(total["n"] + total["v"] + 1, 1))
    common = common_counts(counts)
    model, error = build_filter(train, n, most_bytes)
    logs = {token: math.log10((c + 1) / room) for token, c in common.items()}
    context = docs.sparkSession.sparkContext
    shared_model, shared_logs = context.broadcast(model), context.broadcast(logs)  # most_bytes; COMMON entries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, logs = shared_model.value, shared_logs.value
        for part in _parts(batches):
            words = [words_of(t) for t in part["text"]]
            hashes, word, before = _indexed(words)
            single = model.counts(hashes)
            pairs, at = np.unique(pair_keys(hashes[before], hashes[word]), return_inverse=True)
            share = (single + 1) / room
            chance = (model.counts(pairs)[at] + PRIOR * share[word]) / (single[before] + PRIOR)
            sizes = np.array([len(w) + 1 for w in words])
            scores = np.add.reduceat(np.log10(np.minimum(chance, 1)), np.cumsum(sizes) - sizes)
            known, base, rare = [], [], []
            for tokens in words:
                tokens.append(END)
                seen = Counter(tokens)
                rest = [t for t in seen if t not in logs]
                rare.append([{"token": t, "times": seen.pop(t)} for t in rest])
                known.append(sum(seen.values()))
                base.append(math.fsum(logs[t] * times for t, times in seen.items()))
            yield pd.DataFrame({"row": part["row"], "doc_id": part["doc_id"], "held_out": part["held_out"],
                                "n_tokens": sizes, "known": known, "base": base, "score": scores, "rare": rare})

    scored = stored(rows.withColumn("row", F.monotonically_increasing_id()).mapInPandas(
        run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, "
             "rare array<struct<token: binary, times: long>>"), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.times")
    seen = F.coalesce("n", F.lit(0))
    per_row = (rare.join(counts, "token", "left")
               .select("row", (F.col("times") * F.log10((seen + 1) / F.lit(room))).alias("log"),
                       F.when(seen > 0, F.col("times")).otherwise(0).alias("times"))
               .groupBy("row").agg(F.sum("log").alias("more_base"), F.sum("times").alias("more_known")))
    return scored.drop("rare").join(per_row, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
        F.lit(error).alias("false_positive"))
