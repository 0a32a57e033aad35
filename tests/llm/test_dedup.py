"""Exact, SimHash and embedding deduplication against brute force."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from airloom.llm.components import components, local_roots
from airloom.llm.embedding import near_vectors
from airloom.llm.exact_dedup import build_index, directory, drop_copies, exact_dedup, probes
from airloom.llm.mixing import repeat_to_targets
from airloom.llm.simhash import drop_near_copies, fingerprint, simhash_groups


def grouped(size, pairs):
    parent = list(range(size))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(x) for x in range(size)]


def test_exact_dedup_of_odd_rows(odd_docs):
    rows = exact_dedup(odd_docs, capacity=2).collect()
    assert len(rows) == odd_docs.count()
    by_text = defaultdict(list)
    for r in odd_docs.collect():
        by_text[r["text"] or ""].append(r["doc_id"])
    for text, ids in by_text.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in rows if r["text_sha256"] == digest]
        known = [i for i in ids if i is not None]
        assert {r["keep_id"] for r in own} == {max(known) if known else None}
        assert {r["group_size"] for r in own} == {len(ids)}
        assert sum(r["kept"] for r in own) == 1


def test_exact_dedup_keeps_columns_and_empty_tables(odd_docs, no_docs):
    kept = drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == odd_docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert exact_dedup(no_docs).count() == 0 and drop_copies(no_docs).count() == 0


def test_directory_splits_overfull_buckets_only(spark):
    keys = spark.range(3_000).select(F.when(F.col("id") < 2_000, F.shiftrightunsigned(F.xxhash64("id"), 3))
                                     .otherwise(F.xxhash64("id")).alias("key"))
    cells = directory(keys, capacity=100, max_bits=12).withColumnRenamed("bucket", "b")
    placed = keys.withColumn("cell", F.shiftrightunsigned("key", 52).cast("int")).join(cells, "cell")
    sizes = {(r["b"], r["depth"]): r["n"] for r in placed.groupBy("b", "depth").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 3_000 and max(sizes.values()) <= 100
    assert len({d for _, d in sizes}) > 1
    halves = defaultdict(int)
    for (b, d), n in sizes.items():
        halves[b >> (12 - d + 1), d] += n
    parents = {(b >> (12 - d + 1), d) for b, d in sizes}
    # A bucket was split because its parent held too much.
    for b, d in sizes:
        parent = b >> (12 - d + 1)
        inside = sum(n for (c, e), n in sizes.items() if c >> (12 - d + 1) == parent)
        assert inside > 100, (parent, d, parents)


def test_owners_hold_whole_buckets_and_hot_texts_send_one_entry(spark):
    rows = [(i, f"text {i}") for i in range(50)] + [(1_000 + i, "hot") for i in range(400)] + [(None, None)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for hot_rows in (1, 100, 10_000):  # every text counted beforehand, the hot ones, none
        looked = probes(docs)
        cells, index = build_index(docs, looked, capacity=4, max_bits=5, hot_rows=hot_rows)
        entries = index.collect()
        assert len(entries) == 52 and len({e["key"] for e in entries}) == 52
        sizes = defaultdict(int)
        for e in entries:
            sizes[e["bucket"]] += 1
            assert e["bucket"] == (e["key"] % (1 << 64)) >> 59 >> (5 - e["depth"]) << (5 - e["depth"])
        assert len(sizes) > 5 and sum(n <= 4 for n in sizes.values()) >= len(sizes) - 2
        hot = {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in entries if r["group_size"] > 1}
        assert hot == {hashlib.sha256(b"hot").hexdigest(): (1_399, 400), hashlib.sha256(b"").hexdigest(): (None, 300)}
        assert exact_dedup(docs, capacity=4, max_bits=5, hot_rows=hot_rows).where("kept").count() == 52


def test_texts_of_one_key_are_chained_and_compared(spark, monkeypatch):
    """With a key of the text's length alone most texts collide."""
    from airloom.llm import exact_dedup as module
    monkeypatch.setattr(module.F, "xxhash64", lambda *c: F.length(*c).cast("long") * (1 << 50))
    rows = [(i, "abcdefgh"[i % 8] * (1 + i % 3)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = module.exact_dedup(docs, capacity=2, max_bits=6).collect()
    assert len(found) == 120 and {r["chain"] for r in found} == set(range(8))
    for r in found:
        same = [i for i, t in rows if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(same), len(same), r["doc_id"] == max(same))


def reference_print(text, size):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd_docs, spark):
    for text in [r["text"] or "" for r in odd_docs.collect() if len(r["text"] or "") < 1_000]:
        assert fingerprint(text) == reference_print(text, 3)
    one = spark.createDataFrame([("Some three words",)], "text string").select(F.hex(F.xxhash64(F.lower("text")))).first()[0]
    assert fingerprint("Some three words") == int(one, 16)


@pytest.mark.parametrize("radius,tile", [(2, 256), (2, 3), (9, 4)])
def test_simhash_groups_against_all_pairs(spark, radius, tile):
    draw = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(60):
        words = list(draw.choice(vocabulary, 60 + i))
        texts.append(" ".join(words))
        for _ in range(i % 4):
            words[int(draw.integers(len(words)))] = "other"
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(1_000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = np.array([reference_print(t, 3) for t in texts], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    root = grouped(len(texts), zip(*np.nonzero(np.triu(near, 1))))
    expected = {}
    for i, r in enumerate(root):
        expected.setdefault(r, []).append(1_000 - i)
    found = {r["doc_id"]: r for r in simhash_groups(docs, radius=radius, tile=tile).collect()}
    for i, r in enumerate(root):
        assert found[1_000 - i]["component_id"] == min(expected[r])
        assert found[1_000 - i]["fingerprint"] == f"{int(prints[i]):016x}"


def test_simhash_of_odd_rows(odd_docs, no_docs):
    rows = simhash_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    component = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert component[1] == component[10] == 0 and component[3] == component[4] == 2 and component[8] == 5
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {2, 5}
    assert simhash_groups(no_docs).count() == 0
    kept = drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 5, 6, 7, 9]
    assert drop_near_copies(no_docs).count() == 0


def test_one_of_each_component_stays_on_the_given_documents(spark, folder):
    docs = drop_copies(spark.read.parquet(f"{folder}/documents.parquet"))
    kept = corpus_pipeline.one_of_near(spark, docs, folder)
    assert kept.columns == docs.columns
    groups = {r["component_id"] for r in simhash_groups(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(groups)


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rows = [(1, "alpha beta gamma delta", 1), (1, "something else altogether here now", 2), (2, "alpha beta gamma delta", 3),
            (2, "something else altogether here now", 4), (None, "a third text of some words", 5), (1, "alpha beta gamma delta", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha int")
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [
        ("1", "alpha beta gamma delta"), ("1", "something else altogether here now"), ("None", "a third text of some words")]


@pytest.mark.parametrize("names", [["_id", "_sha", "_sha_"], ["sha", "sha_", "SHA__"], ["_copies", "_copy", "copies"], ["copy", "fp", "root"]])
def test_columns_of_any_name_come_through(spark, names):
    rows = [(i, f"some words number {i // 2}", "en" if i % 2 else "fr", i, 99, None) for i in range(12)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, `{names[0]}` int, `{names[1]}` int, `{names[2]}` string")
    domains = docs.select("doc_id", F.col("lang").alias("domain"))
    for made, n in ((drop_copies(docs), 6), (drop_near_copies(docs), None), (repeat_to_targets(docs, domains, {"en": 0.5, "fr": 0.5}), None)):
        assert made.columns == docs.columns and (n is None or made.count() == n)
        assert all(r[names[1]] == 99 and r[names[0]] == r["doc_id"] and r[names[2]] is None for r in made.collect())


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long"), "test").collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 160)} == {100} and found[300] == 200
    assert len(found) == 41 + 60 + 2
    assert local_roots(6, np.array([5, 3, 4]), np.array([4, 2, 2])).tolist() == [0, 1, 2, 2, 2, 2]


def vector_rows():
    draw = np.random.default_rng(8)
    rows, number = [], 0
    for label in (1, 2):
        for _ in range(25):
            base = draw.normal(size=32)
            for copy in range(int(draw.integers(1, 6))):
                vector = (base + draw.normal(size=32) * 0.09 * copy).tolist()
                rows.append((number, [float(np.float32(x)) for x in vector], label))
                number += 1
    rows += [(number, rows[0][1], 1), (number + 1, rows[0][1], 2), (number + 2, rows[0][1], None), (number + 3, None, 1),
             (number + 4, [0.0] * 32, 1), (number + 5, [float("nan")] + [1.0] * 31, 1), (number + 6, [None] + [1.0] * 31, 1),
             (number + 7, [float("inf")] * 32, 1), (number + 8, [], 1), (number + 9, [1.0, 2.0], 1), (number + 10, [2.0, 4.0], 1)]
    return rows


@pytest.mark.parametrize("tile", [256, 2])
def test_vectors_against_all_pairs(spark, tile):
    rows = vector_rows()
    frame = spark.createDataFrame([(i, v, lab, 0) for i, v, lab in rows],
                                  "vec_id long, embedding array<float>, label int, node int")

    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    pairs = []
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            (_, v, one), (_, w, two) = rows[a], rows[b]
            if one is not None and one == two and usable(v) and usable(w) and len(v) == len(w):
                v, w = np.float32(v).astype(float), np.float32(w).astype(float)
                if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                    pairs.append((a, b))
    links = np.bincount(np.ravel(pairs), minlength=len(rows))
    found = {r["vec_id"]: r for r in near_vectors(frame, tile=tile).collect()}
    assert len(found) == len(rows)
    got = sum(r["n_links"] for r in found.values())
    assert all(found[i]["n_links"] <= links[i] for i in range(len(rows)))
    assert got >= 0.9 * links.sum() and got > 20
    if got == links.sum():
        assert [found[i]["component_id"] for i in range(len(rows))] == grouped(len(rows), pairs)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())
    assert near_vectors(frame.where("false")).count() == 0


def test_recall_on_the_given_vectors(spark, folder):
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = frame.toPandas()
    expected = 0
    for _, part in rows.groupby("label"):
        x = np.array(part["embedding"].tolist(), float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        expected += int((np.triu(x @ x.T >= 0.98, 1)).sum()) * 2
    got = near_vectors(frame).agg(F.sum("n_links")).first()[0]
    assert 0.9 * expected <= got <= expected
