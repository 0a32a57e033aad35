"""Row numbers over slices against a plain count."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from airloom.operators.filters import page
from airloom.operators.positions import deep_page, numbered, ranked


def test_numbers_of_groups_cut_into_slices(spark):
    draw = random.Random(4)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", draw.randint(0, 10_000), i) for i in range(3_000)]
    frame = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    made = numbered(frame, ["g"], [F.col("v").desc(), "i"], total="size", slices=11)
    assert made.columns == ["g", "v", "i", "position", "size"]
    expected = defaultdict(list)
    for g, v, i in rows:
        expected[g].append((-v, i))
    found = {r["i"]: (r["position"], r["size"]) for r in made.collect()}
    assert len(found) == len(rows)
    for members in expected.values():
        for place, (_, i) in enumerate(sorted(members)):
            assert found[i] == (place, len(members))


def test_one_group_ties_and_empty_tables(spark):
    frame = spark.createDataFrame([(1,)] * 40 + [(None,)] * 3, "v int")
    found = sorted((r["position"], r["v"]) for r in numbered(frame, [], [F.col("v").asc_nulls_first()], slices=4).collect())
    assert [p for p, _ in found] == list(range(43)) and [v for _, v in found[:3]] == [None] * 3
    assert numbered(frame.where("false"), ["v"], ["v"], total="n").count() == 0


def test_ranks_share_places_and_put_null_last(spark):
    draw = random.Random(9)
    rows = [(f"g{i % 2}", None if i % 11 == 0 else float(draw.randint(0, 20)), i, "x") for i in range(600)] + [("hot", 1.0, i, "x") for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, v double, i int, rank string").repartition(4).drop("rank")
    found = {(r["g"], r["i"]): r["rank"] for r in ranked(frame, ["g"], "v").collect()}
    for g, v, i, _ in rows:
        lower = sum(1 for h, w, _, _ in rows if h == g and w is not None and (v is None or w < v))
        assert found[g, i] == lower + 1
    assert ranked(frame.where("false"), ["g"], "v").count() == 0


def test_deep_pages_and_pages_after_a_row(spark):
    frame = spark.createDataFrame([(i * 7 % 1_000, str(i)) for i in range(1_000)], "a int, b string").repartition(6)
    for skip, limit in ((0, 10), (777, 50), (990, 100), (2_000, 5)):
        assert [r["a"] for r in deep_page(frame, ["a"], skip, limit).collect()] == list(range(1_000))[skip:skip + limit]
    assert "Offset" not in deep_page(frame, ["a"], 777, 50)._jdf.queryExecution().toString()
    seen, after = [], None
    while rows := page(frame.where("a < 100"), ["a", "b"], limit=33, after=after).collect():
        seen += [r["a"] for r in rows]
        after = tuple(rows[-1])
    assert seen == list(range(100))
