"""Token ids in files: blocks of ids turned into bit or byte planes, each plane compressed, with an index of the blocks."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import suppress
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from airloom.llm.common import stored, texts
from airloom.session import ensure_checkpoint_folder, work_folder

BLOCK = 65_536  # ids per block
FILE_IDS = 1 << 25  # ids of a file, about
LEAST_IDS = 1 << 20  # a table is not cut into files smaller than this for the sake of more tasks
READ_BLOCKS = 64  # blocks that a reading task takes
LEVEL = 3
ROWS = 500  # documents per batch handed back
MEMO, MEMO_CHARS = 600_000, 64  # words, twice so many at most, whose ids a worker remembers, and their length
PIECES_KEPT = 300_000
STRETCH = 1 << 20  # characters of a long text that are cut into words at once
END = 0

# Fixed values of the file format: 8 bytes at both ends, the record of a block and what closes the file.
MAGIC = b"AIRIDS01"
BLOCK_RECORD = np.dtype([("offset", "<u8"), ("first", "<u8"), ("ids", "<u4"), ("docs", "<u4"), ("planes", "<u2"),
                         ("bits", "<u2"), ("crc", "<u4"), ("bytes", "<u4")])
TRAILER = struct.Struct("<QII8s")  # offset of the index, its records, its crc32, magic


# Encoding

# The pattern of byte-level pieces, over characters whose class no version of the tables disputes.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \t\n\r0-9{_LETTERS}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
PLAIN = re.compile(f"[\t\n\r -~{_LETTERS}]*").fullmatch
# A byte that prints stands for itself, the others for the letters from U+0100 on, in order.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}


def _one_by_one(settings: dict) -> bool:
    """Whether the file describes plain byte-level BPE, whose pieces hold white space at their front only."""
    split = settings.get("pre_tokenizer") or {}
    return (settings["model"]["type"] == "BPE" and settings.get("normalizer") is None
            and settings.get("post_processor") is None and settings.get("truncation") is None
            and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"))


class TextEncoder:
    """Ids of texts as the library gives them, packed in ``width`` bytes each.

    A byte-level piece holds white space before its letters, digits or signs or consists of it, so every space that
    follows something else starts a new piece, and the words between such spaces are encoded by themselves, equal
    ones once. New words of plain characters are cut into pieces here, and the library's model gives the ids of new
    pieces; all other words the library encodes whole. Texts that hold the string of an added token, and those of other
    kinds of tokenisers, are not cut at all.
    """

    # U+180E counts as white space in old tables only; cutting less is always right.
    _space_after_space = re.compile("[\\s\u180e] ").search
    _cut = re.compile("(?<=[^\\s\u180e]) ")

    def __init__(self, settings: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_str(settings)
        told = json.loads(settings)
        self.added = [t["content"] for t in told.get("added_tokens", [])]
        self.by_piece = _one_by_one(told)
        self.width = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        letter = "H" if self.width.itemsize == 2 else "I"
        self.packs = [struct.Struct(f"<{n}{letter}").pack for n in range(64)]
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}  # ids of a space and the word
        self.older: dict[str, bytes] = {}

    def whole(self, strings: list[str]) -> list[bytes]:
        made = self.library.encode_batch_fast(strings, add_special_tokens=False)
        return [np.array(e.ids, self.width).tobytes() for e in made]

    def learn_pieces(self, pieces: list[str]) -> None:
        """Ids of pieces: their bytes, written in the letters the vocabulary is kept in, through the library's model."""
        tokenize, packs, made = self.library.model.tokenize, self.packs, []
        for told in "\0".join(pieces).encode().decode("latin-1").translate(BYTE_LETTERS).split(BYTE_LETTERS[0]):
            ids = [token.id for token in tokenize(told)]
            made.append(packs[len(ids)](*ids) if len(ids) < 64 else np.array(ids, self.width).tobytes())
        self.pieces.update(zip(pieces, made))

    def learn_words(self, words: set[str]) -> None:
        plain = list(filter(PLAIN, words))
        cut = list(map(PIECES.findall, map(" ".__add__, plain)))
        if len(self.pieces) > PIECES_KEPT:
            self.pieces.clear()
        new = list(set(chain.from_iterable(cut)).difference(self.pieces))
        if new:
            self.learn_pieces(new)
        ids = self.pieces.__getitem__
        self.words.update(zip(plain, [ids(parts[0]) if len(parts) == 1 else b"".join(map(ids, parts)) for parts in cut]))
        others = list(words.difference(plain))
        self.words.update(zip(others, self.whole([" " + w for w in others])))

    def spaced(self, words: list[str]) -> bytes:
        """Ids of the words with a space before each. Words not met for ``MEMO`` new ones are forgotten."""
        ids = list(map(self.words.get, words))
        at, unknown = -1, []
        with suppress(ValueError):
            while True:
                unknown.append(at := ids.index(None, at + 1))
        if unknown:
            new = {words[i] for i in unknown}
            if len(self.words) > MEMO:
                self.older, self.words = self.words, {}
            known = set(filter(self.older.__contains__, new))
            self.words.update(zip(known, map(self.older.__getitem__, known)))
            self.learn_words(new - known)
            for i in unknown:
                ids[i] = self.words[words[i]]
            for word in new:
                if len(word) > MEMO_CHARS:
                    del self.words[word]
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        if not self.by_piece or any(a in text for a in self.added):
            return self.whole([text])[0]
        made, start = [], 0
        while start < len(text):  # a stretch of a long text at a time
            cut = self._cut.search(text, start + STRETCH) if len(text) > start + STRETCH else None
            stretch, start = (text[start:cut.start()], cut.start()) if cut else (text[start:], len(text))
            words = self._cut.split(stretch) if self._space_after_space(stretch) else stretch.split(" ")
            made += self.whole(words[:1])
            made.append(self.spaced(words[1:]))
        return b"".join(made)


@lru_cache(maxsize=2)
def encoder_of(settings: str) -> TextEncoder:
    """A worker keeps its encoder, and the words it knows, from task to task."""
    return TextEncoder(settings)


def encode_texts(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """``doc_id, n_tokens, ids, place`` of every row of ``docs`` (``doc_id``, ``text``; others ignored).

    ``ids`` holds the library's ids, packed, and ``end`` after them; a null text is empty and has ``end`` alone. ``path`` is a
    tokeniser file that the driver reads. ``place`` numbers the rows.
    """
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # as large as the tokeniser file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        last = np.array([end], encoder.width).tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                made = [encoder.encode(text) + last for text in part.column(1).to_pylist()]
                sizes = pa.array([len(ids) // encoder.width.itemsize for ids in made], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(made, pa.binary())],
                                                 ["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary").withColumn(
        "place", F.monotonically_increasing_id())


# Blocks and files

def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Plane i of a block holds byte (or bit) i of every id, lowest first; planes above the largest id are left out."""
    count = max(1, int(ids.max(initial=0)).bit_length())
    if bits:
        spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        return [np.packbits(spread[:, i], bitorder="little").tobytes() for i in range(count)]
    spread = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [spread[:, i].tobytes() for i in range((count + 7) // 8)]


def from_planes(planes: list[bytes], size: int, bits: bool) -> np.ndarray:
    whole = np.zeros((size, 32 if bits else 4), np.uint8)
    for i, plane in enumerate(planes):
        made = np.frombuffer(plane, np.uint8)
        whole[:, i] = np.unpackbits(made, count=size, bitorder="little") if bits else made
    return (np.packbits(whole, axis=1, bitorder="little") if bits else whole).view("<u4").ravel()


class FileWriter:
    """Writes documents to one file, a block at a time.

    A block is its compressed planes and a compressed table of the documents that start in it; sizes precede both.
    Documents run on over blocks. The index at the end has a record per block: where it lies, which ids it
    holds, how many documents start in it, and its checksum.
    """

    def __init__(self, sink, bits: bool = False, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.held: list[np.ndarray] = []
        self.waiting = self.ids = self.docs = 0
        self.starts: list[tuple[int, int, int, bool]] = []  # place in the file, ids, doc_id, whether it has one
        self.index: list[tuple] = []
        sink.write(MAGIC)
        self.offset = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.starts.append((self.ids, len(ids), doc_id or 0, doc_id is not None))
        self.docs += 1
        self.ids += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            flat = np.concatenate(self.held)
            full = len(flat) // self.block * self.block
            for at in range(0, full, self.block):
                self._put(flat[at:at + self.block])
            self.held, self.waiting = [flat[full:]], len(flat) - full

    def _put(self, ids: np.ndarray) -> None:
        first = self.index[-1][1] + self.index[-1][2] if self.index else 0
        count = next((i for i, s in enumerate(self.starts) if s[0] >= first + len(ids)), len(self.starts))
        own, self.starts = self.starts[:count], self.starts[count:]
        table = np.array([s[:3] for s in own], "<i8").reshape(-1, 3).T
        known = np.packbits([s[3] for s in own]) if own else np.zeros(0, np.uint8)
        parts = [self.pack.compress(p) for p in (*to_planes(ids, self.bits), table.tobytes() + known.tobytes())]
        body = np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)
        self.sink.write(body)
        self.index.append((self.offset, first, len(ids), len(own), len(parts) - 1, self.bits, zlib.crc32(body), len(body)))
        self.offset += len(body)

    def close(self) -> None:
        if self.waiting:
            self._put(np.concatenate(self.held))
        index = np.array(self.index, BLOCK_RECORD).tobytes()
        self.sink.write(index + TRAILER.pack(self.offset, len(self.index), zlib.crc32(index), MAGIC))
        self.offset += len(index) + TRAILER.size


class FileReader:
    """Reads blocks of a file through its index."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - TRAILER.size)
        offset, records, crc, magic = TRAILER.unpack(source.read(TRAILER.size))
        source.seek(offset)
        raw = source.read(records * BLOCK_RECORD.itemsize)
        if magic != MAGIC or zlib.crc32(raw) != crc:
            raise ValueError("not a whole token file")
        self.index = np.frombuffer(raw, BLOCK_RECORD)
        self.unpack = zstandard.ZstdDecompressor()

    def block(self, number: int) -> tuple[np.ndarray, list[tuple[int, int, int | None]]]:
        """Ids of a block, and place, length and doc_id of the documents that start in it."""
        record = self.index[number]
        self.source.seek(int(record["offset"]))
        body = self.source.read(int(record["bytes"]))
        if zlib.crc32(body) != record["crc"]:
            raise ValueError(f"block {number} is damaged")
        sizes = np.frombuffer(body, "<u4", int(record["planes"]) + 1)
        ends = (len(sizes) * 4 + np.cumsum(sizes)).tolist()
        parts = [self.unpack.decompress(body[e - s:e]) for s, e in zip(sizes.tolist(), ends)]
        docs = int(record["docs"])
        table = np.frombuffer(parts[-1], "<i8", 3 * docs).reshape(3, docs).T.tolist()
        known = np.unpackbits(np.frombuffer(parts[-1], np.uint8, offset=24 * docs), count=docs).tolist()
        return (from_planes(parts[:-1], int(record["ids"]), bool(record["bits"])),
                [(at, n, doc if k else None) for (at, n, doc), k in zip(table, known)])

    def documents(self, first: int = 0, last: int | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
        """Place, doc_id and ids of the documents that start in blocks ``first`` up to ``last``, read to their ends."""
        number, last = first, len(self.index) if last is None else last
        waiting: list[tuple[int, int, int | None]] = []
        kept, start = np.zeros(0, "<u4"), int(self.index[first]["first"]) if len(self.index) else 0
        while number < last or waiting:
            ids, docs = self.block(number)
            parts = [kept, ids]
            if number < last:
                waiting += docs
            if waiting and waiting[0][0] + waiting[0][1] > start + len(kept) + len(ids):  # a document of many blocks
                need = waiting[0][0] + waiting[0][1] - start - len(kept) - len(ids)
                while need > 0:
                    number += 1
                    ids, docs = self.block(number)
                    parts.append(ids)
                    need -= len(ids)
                    if number < last:
                        waiting += docs
            kept, number, done = np.concatenate(parts), number + 1, 0
            for at, n, doc in waiting:
                if at + n > start + len(kept):
                    break
                yield at, doc, kept[at - start:at - start + n]
                done += 1
            waiting = waiting[done:]
            keep_from = waiting[0][0] - start if waiting else len(kept)
            start, kept = start + keep_from, kept[keep_from:]


# Tables to files and back

@dataclass
class TokenFiles:
    """What was written: ``manifest`` has a row per file with ``file, path, docs, ids, blocks, bytes, first``."""

    folder: str
    manifest: DataFrame


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))


MANIFEST = T.StructType([T.StructField(n, T.StringType() if n == "path" else T.LongType())
                         for n in ("file", "path", "docs", "ids", "blocks", "bytes")])


def write_files(encoded: DataFrame, folder: str, width: int, bits: bool = False, file_ids: int = FILE_IDS,
                block: int = BLOCK) -> TokenFiles:
    """Files of ``encoded`` (``doc_id, n_tokens, ids, place``, stored) in ``folder``, in ascending order of doc_id.

    Rows are range partitioned by doc_id (null first), then by their ids and place, so even one id may fill several
    files; each partition is sorted and written by one task, block by block. A task writes under a name of its own and
    then moves the file to its place: a task that is run again or lost halfway leaves the same file or none. What
    the manifest lists is what the finished tasks told.
    """
    sized = encoded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("ids")).first()["ids"]
    spark = encoded.sparkSession
    files = max(1, -(-sized // file_ids), min(spark.sparkContext.defaultParallelism, -(-sized // LEAST_IDS)))
    _opened(folder)[0].create_dir(_opened(folder)[1], recursive=True)
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, (disk, base) = TaskContext.get().partitionId(), _opened(folder)
        writer, draft, kind = None, f"{base}/_draft-{uuid.uuid4().hex}", np.dtype(f"<u{width}")
        with disk.open_output_stream(draft) as sink:
            writer = FileWriter(sink, bits, block)
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                    writer.add(doc, np.frombuffer(ids.as_buffer(), kind).astype("<u4"))
            writer.close()
        path = f"{base}/part-{number:06d}.ids"
        disk.move(draft, path)
        told = [number, path, writer.docs, writer.ids, len(writer.index), writer.offset]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in told], MANIFEST.names)

    ranged = encoded.repartitionByRange(files, *keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    manifest = stored(ranged.mapInArrow(run, MANIFEST), "token-manifest")
    # One row per file, of millions of ids each.
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    return TokenFiles(folder, manifest.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0))))


def read_files(written: TokenFiles, blocks: int = READ_BLOCKS) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files; ``ids`` are little-endian 32-bit numbers.

    ``start`` counts the ids of all documents before it. A task takes the documents that start in ``blocks`` blocks of a file,
    found through its index.
    """
    tasks = written.manifest.where("blocks > 0").select("path", "first", "blocks", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(blocks).cast("long"))).alias("block"))
    tasks = stored(tasks, "token-reads")
    disk_folder = written.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, _ = _opened(disk_folder)
        for batch in batches:
            for task in batch.to_pylist():
                with disk.open_input_file(task["path"]) as source:
                    reader = FileReader(source, source.size())
                    found = reader.documents(task["block"], min(task["block"] + blocks, task["blocks"]))
                    yield from _batches(found, task["first"])

    return tasks.repartition(max(1, tasks.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _batches(found: Iterable[tuple[int, int | None, np.ndarray]], first: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0

    def packed() -> pa.RecordBatch:
        doc, start, ids = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(i) for i in ids], pa.int64()),
             pa.array([i.tobytes() for i in ids], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    for at, doc, ids in found:
        rows.append((doc, first + at, ids))
        size += len(ids)
        if len(rows) >= ROWS or size >= BLOCK * 8:
            yield packed()
            rows, size = [], 0
    if rows:
        yield packed()


def write_token_files(docs: DataFrame, path: str, folder: str | None = None, end: int = END, **settings) -> TokenFiles:
    """Token files of ``docs`` (``doc_id``, ``text``; others ignored) by the tokeniser in ``path``, in ``folder``.

    ``folder`` must be one that pyarrow reaches from every machine; by default it is a fresh one in the shared
    folder. Every row gives a document, also with null or repeated ids; a null text is empty and has only ``end``; a text
    may be of any length. Rows of equal id are ordered by a hash of their ids. No rows give one file without blocks.
    """
    ensure_checkpoint_folder(docs.sparkSession)
    encoded = stored(encode_texts(docs, path, end), "token-ids")
    with open(path, encoding="utf-8") as file:
        width = TextEncoder(file.read()).width.itemsize
    return write_files(encoded, folder or work_folder(docs.sparkSession, "token-files"), width, **settings)
