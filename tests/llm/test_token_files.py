"""Token files: ids against the library, files against what was written."""

import io
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from airloom.llm.queries import QUERIES, TOKENISER
from airloom.llm.token_files import (BLOCK_RECORD, TRAILER, FileReader, FileWriter, TextEncoder, encode_texts, from_planes,
                                     read_files, to_planes, write_files, write_token_files)

PATH = public_tokenizers.path(TOKENISER)
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = TextEncoder(open(PATH, encoding="utf-8").read())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def own(text):
    return np.frombuffer(ENCODER.encode(text), ENCODER.width).tolist()


@pytest.mark.parametrize("text", [
    "", " ", "   ", "a  b", "a   b", "\n a", "a \n b", "a\n \nb", "x\t y", "x  y   z", "it's  I'll 're", "a <|endoftext|> b",
    "<|endoftext|>", " lead", "trail ", "tab\t", "᠎ a᠎ b", "1 22 333 a1 .. !!", "東京 は 　 x", "é ́ ‍ ퟿",
    "one\x1c two\x85 three", "word " * 500_000, "x" * 300_000 + " y"])
def test_parts_give_the_ids_of_the_whole_text(text):
    assert own(text) == ids_of(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sl1. \n\t ᠎ é東_")), max_size=40))
def test_any_white_space(text):
    assert own(text) == ids_of(text)


def test_other_kinds_of_tokenisers_see_whole_texts():
    other = public_tokenizers.path("word_bpe_49k.json")
    encoder = TextEncoder(open(other, encoding="utf-8").read())
    assert not encoder.by_piece
    for text in ("Some  words ", "", "x y"):
        found = np.frombuffer(encoder.encode(text), encoder.width).tolist()
        assert found == Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
def test_planes(bits):
    draw = np.random.default_rng(1)
    for top in (1, 2, 255, 256, 50_257, 1 << 16, (1 << 32) - 1):
        ids = draw.integers(0, top, 1_001, dtype=np.uint64).astype("<u4")
        planes = to_planes(ids, bits)
        assert len(planes) <= (32 if bits else 4)
        assert from_planes(planes, len(ids), bits).tolist() == ids.tolist()
    assert len(to_planes(np.full(10, 300, "<u4"), True)) == 9 and len(to_planes(np.full(10, 300, "<u4"), False)) == 2


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_of_one_file(bits, block):
    draw = np.random.default_rng(block)
    docs = [(None if i % 5 == 0 else i - 3, draw.integers(0, 70_000, int(draw.choice([1, 2, 7, 63, 64, 65, 300]))).astype("<u4"))
            for i in range(60)]
    sink = io.BytesIO()
    writer = FileWriter(sink, bits, block)
    for doc, ids in docs:
        writer.add(doc, ids)
    writer.close()
    raw = sink.getvalue()
    assert len(raw) == writer.offset
    reader = FileReader(io.BytesIO(raw), len(raw))
    starts = np.cumsum([0] + [len(i) for _, i in docs])
    expected = [(int(s), d, i.tolist()) for s, (d, i) in zip(starts, docs)]
    assert [(a, d, i.tolist()) for a, d, i in reader.documents()] == expected
    for step in (1, 3):  # every document is read once, by the task in whose blocks it starts
        found = [(a, d, i.tolist()) for b in range(0, len(reader.index), step)
                 for a, d, i in reader.documents(b, min(b + step, len(reader.index)))]
        assert found == expected
    broken = bytearray(raw)
    broken[40] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(FileReader(io.BytesIO(bytes(broken)), len(raw)).documents())
    broken = bytearray(raw)
    broken[-TRAILER.size - BLOCK_RECORD.itemsize] ^= 1
    with pytest.raises(ValueError, match="whole"):
        FileReader(io.BytesIO(bytes(broken)), len(raw))


def expected_rows(docs, key=lambda i: (i is not None, i or 0)):
    return sorted(((d["doc_id"], d["text"] or "") for d in docs), key=lambda d: key(d[0]))


@pytest.mark.parametrize("options", [{}, {"file_ids": 700, "block": 64}, {"bits": True, "file_ids": 5_000, "block": 1_000}])
def test_odd_documents(spark, odd_docs, options):
    made = write_token_files(odd_docs.repartition(3), PATH, **options)
    rows = read_files(made, blocks=3).orderBy("start").collect()
    docs = expected_rows([r.asDict() for r in odd_docs.collect()])
    assert [r["doc_id"] for r in rows] == [i for i, _ in docs]
    at, left = 0, {}
    for i, text in docs:
        left.setdefault(i, []).append([*ids_of(text), 0])
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        left[r["doc_id"]].remove(ids)
        assert r["start"] == at and r["n_tokens"] == len(ids)
        at += len(ids)
    files = made.manifest.orderBy("file").collect()
    assert sum(f["ids"] for f in files) == at and (len(files) > 3) == ("file_ids" in options)
    assert [f["first"] for f in files] == np.cumsum([0] + [f["ids"] for f in files])[:-1].tolist()


def test_no_documents_and_one_id_in_many_files(spark, no_docs):
    assert read_files(write_token_files(no_docs, PATH)).count() == 0
    same = spark.createDataFrame([(7, f"text {i % 2}") for i in range(300)], "doc_id long, text string").repartition(4)
    made = write_token_files(same, PATH, file_ids=100)
    assert made.manifest.where("docs > 0").count() > 5
    assert read_files(made).agg(F.count("*"), F.max("start") + F.max("n_tokens")).first()[:2] == (300, 300 * 3)


def test_a_writer_that_runs_again_leaves_the_same_files(spark, odd_docs):
    from airloom.llm.common import stored
    from airloom.session import work_folder
    encoded, folder = stored(encode_texts(odd_docs, PATH), "again"), work_folder(spark, "again")
    told = [write_files(encoded, folder, 2, file_ids=20_000).manifest.orderBy("file").toPandas() for _ in range(2)]
    assert told[0].equals(told[1])


def test_the_query_on_the_given_documents(spark, folder):
    docs = expected_rows([r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()])
    found = {r["doc_id"]: r for r in QUERIES["op12_token_files"](spark, folder).collect()}
    assert len(found) == len(docs)
    at = 0
    for i, text in docs:
        ids = np.array([*ids_of(text), 0], "<u4")
        assert tuple(found[i]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert json.loads(open(PATH, encoding="utf-8").read())["model"]["type"] == "BPE"
