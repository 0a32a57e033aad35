"""The Merkle manifest against trees built in full."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from airloom.llm.merkle import FIELDS, build_manifest, folded, leaf, path_digest, verify
from airloom.llm.queries import QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    told = [None if row[f] is None else str(row[f]) for f in FIELDS]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in told])


def tree_of(leaves):
    """Root, and for every leaf its runs upwards as (siblings before, siblings after)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for path, i in zip(paths, at):
            first = i // 3 * 3
            path.append(("".join(level[first:i]), "".join(level[i + 1:first + 3])))
        level = [h(*level[i:i + 3]) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def expected(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for name in names:
        trees[name].sort(key=lambda t: t[:3])
        made[name] = tree_of([t[2] for t in trees[name]])
    root, tops = tree_of([made[n][0] for n in names])
    out = []
    for name, top in zip(names, tops):
        for (_, _, own, row), path in zip(trees[name], made[name][1]):
            whole, shown = path + top, dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and row["text"]:
                shown["text"] = row["text"].replace("\n", "")
            end = leaf_of(shown)
            for before, after in whole:
                end = h(before, end, after)
            out.append((row["doc_id"], own, made[name][0], root, h(*[a + b for a, b in whole]), end, end == root))
    return sorted(out, key=str)


def proofs_of(docs):
    lossy = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = [F.when(lossy, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")) if f == "text" else F.col(f)
             for f in FIELDS]
    made = verify(build_manifest(docs, also={"shown": leaf(shown)}).proofs(), "shown")
    return made.select("key", "leaf", "subroot", "root", path_digest(F.col("path")), "folded_root", "verified")


def make(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 1) for r in rows],
        "doc_id long, source string, lang string, n_chars long, text string, tree string, position int")


def against_full_trees(docs):
    assert sorted((tuple(r) for r in proofs_of(docs).collect()), key=str) == expected([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, "b": 4}, {"a": 81, "b": 82, "c": 1, "d": 27},
                                   {"hot": 800, None: 30, "": 1, "Ä": 9, "z": 10, "zz": 28}, {f"s{i}": 1 + i % 3 for i in range(90)}])
def test_trees_of_many_sizes(spark, sizes):
    rows, n = [], 0
    for source, size in sizes.items():
        for i in range(size):
            rows.append(((n * 7919) % 100_003, source, "en" if i % 3 else None, i, f"text {i}\nline\n" if i % 2 else f"t{i}"))
            n += 1
    against_full_trees(make(spark, rows))


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "x\ny"),
            (1, "a", "en", 3, "other"), (None, "a", "de", None, ""), (2, "a", None, 0, "-"), (3, "b", "", None, None),
            (4, "b", "fr", 1, "\n"), (5, "b", "fr", 400_000, "long\n" * 80_000), (-6, "", "en", 2, "東京\n")]
    against_full_trees(make(spark, rows))
    empty = build_manifest(make(spark, rows).where("false"))
    assert empty.proofs().count() == 0 and empty.root() is None and empty.subroots().count() == 0


def test_proofs_of_some_rows_and_tampering(spark):
    rows = [(i, "s" if i % 4 else "t", "en", i, f"text {i}") for i in range(400)]
    made = build_manifest(make(spark, rows))
    every = {(r["tree"], r["position"]): r for r in made.proofs().collect()}
    assert len(every) == 400
    wanted = spark.createDataFrame([("s", 0), ("s", 299), ("t", 57), ("t", 5_000)], "tree string, position long")
    some = made.proofs(wanted)
    found = {(r["tree"], r["position"]): r for r in some.collect()}
    assert set(found) == {("s", 0), ("s", 299), ("t", 57)}
    assert all(found[k]["path"] == every[k]["path"] for k in found)
    checked = verify(some, "leaf").select("verified", F.size("path").alias("n"),
                                          (folded(F.col("path"), F.lit("0" * 64)) == F.col("root")).alias("fooled")).collect()
    assert all(r["verified"] and not r["fooled"] for r in checked) and {r["n"] for r in checked} == {7, 6}
    assert made.subroots().count() == 2
    assert made.root() == build_manifest(make(spark, rows[::-1]).repartition(7)).root()


def test_the_query_on_the_given_documents(spark, folder):
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = QUERIES["op13_merkle_manifest"](spark, folder)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(rows)
