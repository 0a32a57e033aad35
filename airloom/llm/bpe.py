"""Byte-level BPE: a minimal perfect hash for pieces in the vocabulary, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from airloom.llm.common import texts

MEMO = 600_000  # pieces whose ids a worker remembers before it starts anew
ROWS = 1_000  # documents per batch handed back
# Code points that this regex module counts as letters and the tokeniser's older Unicode tables do not.
NEWER_LETTERS = ("\u209d-\u209f\ua7dd\U00010ed9-\U00010eee\U00011db0-\U00011ddb\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
                 "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
                 "\U0001b123-\U0001b128\U0001df2b-\U0001df81\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
                 "\U0001e6e7-\U0001e6ed\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f")
LOAD = 4  # vocabulary entries per displacement


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and a number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _hashes(keys: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64)


def _slots(hashes: np.ndarray, moves: np.ndarray, size: int) -> np.ndarray:
    """Slot of a hash under a displacement; a negative displacement is the slot itself."""
    mixed = hashes + np.maximum(moves, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    moved = (mixed ^ (mixed >> np.uint64(32))) % np.uint64(size)
    return np.where(moves < 0, -moves - 1, moved.astype(np.int64))


@dataclass
class PerfectHash:
    """Every key of a fixed set in its own slot of as many slots as keys; other keys land anywhere."""

    moves: np.ndarray
    size: int

    @classmethod
    def build(cls, keys: list[bytes]) -> tuple[PerfectHash, np.ndarray]:
        """The function and each key's slot: groups of keys, largest first, are displaced until all fit."""
        hashes = _hashes(keys)
        size = len(keys)
        count = size // LOAD + 1
        group = (hashes >> np.uint64(32)) % np.uint64(count)
        order = np.argsort(group, kind="stable")
        members = np.split(order, np.cumsum(np.bincount(group.astype(np.int64), minlength=count))[:-1])
        moves, taken = np.zeros(count, np.int64), np.zeros(size, bool)
        tries = np.arange(64)
        for g in sorted(range(count), key=lambda i: -len(members[i])):
            own = hashes[members[g]]
            if len(own) < 2:
                break
            move = 0
            while True:
                at = _slots(own[None, :], (tries + move)[:, None], size)
                ok = ~taken[at].any(1) & (np.diff(np.sort(at, 1), axis=1) > 0).all(1)
                if ok.any():
                    move += int(ok.argmax())
                    taken[at[ok.argmax()]] = True
                    break
                move += len(tries)
            moves[g] = move
        free = iter(np.flatnonzero(~taken))
        for g in range(count):
            if len(members[g]) == 1:
                moves[g] = -int(next(free)) - 1
        made = cls(moves, size)
        return made, made.slots(hashes)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return _slots(hashes, self.moves[(hashes >> np.uint64(32)) % np.uint64(len(self.moves))], self.size)


class Vocabulary:
    """Tokens in slot order with their ids, the ranks for merging, and the bytes by id for decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        self.ranks = ranks
        self.hash, slots = PerfectHash.build(keys)
        self.tokens: list[bytes] = [b""] * len(keys)
        self.ids = np.zeros(len(keys), np.int32)
        for key, slot in zip(keys, slots):
            self.tokens[slot], self.ids[slot] = key, ranks[key]
        by_id = sorted(ranks, key=ranks.get)
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[[ranks[k] for k in by_id]] = [len(k) for k in by_id]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def whole(self, pieces: list[bytes]) -> list[int | None]:
        """Ids of the pieces that are tokens themselves: one slot each, and the token in it must be the piece."""
        slots = self.hash.slots(_hashes(pieces)).tolist()
        return [int(self.ids[s]) if self.tokens[s] == piece else None for s, piece in zip(slots, pieces)]

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece by merges of lowest rank first, leftmost among equals."""
        ranks, size = self.ranks, len(piece)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(ranks[pair], i, i + 2) for i in range(size - 1) if (pair := piece[i:i + 2]) in ranks]
        heapq.heapify(heap)
        gone = bytearray(size)
        while heap:
            _, left, end = heapq.heappop(heap)
            right = after[left]
            if gone[left] or right >= size or after[right] != end:
                continue
            gone[right] = 1
            after[left] = end
            if end < size:
                before[end] = left
                last = after[end]
                if (pair := piece[left:last]) in ranks:
                    heapq.heappush(heap, (ranks[pair], left, last))
            if left:
                first = before[left]
                if (pair := piece[first:end]) in ranks:
                    heapq.heappush(heap, (ranks[pair], first, end))
        out, at = [], 0
        while at < size:
            out.append(ranks[piece[at:after[at]]])
            at = after[at]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        length = self.lengths[ids]
        ends = np.cumsum(length)
        at = np.repeat(self.starts[ids] - (ends - length), length) + np.arange(ends[-1])
        return self.bytes[at].tobytes()


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Splits a text into its pieces; texts with newer letters need a slower pattern that leaves these out of ``\\p{L}``."""
    plain, newer = regex.compile(pattern).findall, regex.compile(f"[{NEWER_LETTERS}]").search
    strict = regex.compile(pattern.replace(r"\p{L}", rf"[\p{{L}}--[{NEWER_LETTERS}]]"), regex.V1).findall
    return lambda text: strict(text) if newer(text) else plain(text)


@lru_cache(maxsize=4)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def _coded(docs: DataFrame, path: str, pattern: str, back: bool) -> DataFrame:
    """Rows with their ids and, with ``back``, the bytes these stand for: one pass of one worker per task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_of(path))  # as large as the rank file
    schema = "doc_id long, n_tokens long, ids array<int>" + (", decoded binary" if back else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, split, memo = shared.value, splitter(pattern), {}
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                made = []
                for text in part.column(1).to_pylist():
                    pieces = split(text)
                    fresh = set(pieces).difference(memo)
                    if fresh:
                        if len(memo) > MEMO:
                            memo.clear()
                            fresh = set(pieces)
                        raw = [p.encode() for p in fresh]
                        for piece, own, found in zip(fresh, raw, vocabulary.whole(raw)):
                            memo[piece] = _packed(vocabulary.merged(own) if found is None else [found])
                    made.append(b"".join(map(memo.__getitem__, pieces)))
                sizes = np.array([len(m) // 4 for m in made], np.int64)
                flat = np.frombuffer(b"".join(made), np.int32)
                ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(flat))
                columns = [part.column(0), pa.array(sizes), ids]
                if back:
                    ends = np.cumsum(sizes)
                    columns.append(pa.array([vocabulary.decode(flat[x:y]) for x, y in zip(ends - sizes, ends)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts(docs).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: what :func:`encode` gives, and the bytes its ids stand for."""
    return _coded(docs, path, pattern, back=True)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` for every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    ``path`` is a rank file that the driver reads, ``pattern`` splits the text into pieces; each piece is encoded by
    itself and no special tokens exist. A null text is empty and has no ids. Ids may be null and repeat;
    every row gives a row. Texts and pieces have no length limit: a piece costs n log n.
    """
    return _coded(docs, path, pattern, back=False)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (``doc_id, n_tokens, ids``) with ``decoded``, the bytes its ids stand for; no ids give none."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                lists = part.column(2)
                flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
                made = [vocabulary.decode(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(made, pa.binary())],
                                                 ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, decoded binary")
