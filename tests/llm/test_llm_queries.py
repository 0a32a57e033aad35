"""The registered queries: SQL where there is some, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from airloom.llm.queries import ORACLE, QUERIES, table

TABLES = ("documents", "pages", "labels", "embeddings")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, folder, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    expected = duck.execute(ORACLE[name]).df()
    found = QUERIES[name](spark, folder).toPandas()
    assert sorted(found.columns) == sorted(expected.columns)
    columns = sorted(found.columns)

    def rows(frame):
        plain = frame[columns].astype(object).where(frame[columns].notna(), None)
        return sorted((tuple(str(v) for v in r) for r in plain.itertuples(index=False)))

    assert rows(found) == rows(expected)


def test_pipeline(spark, folder):
    docs = table(spark, folder, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        seen[name] = docs.toPandas()
    quality, exact, near, mixed = (seen[n] for n, _ in corpus_pipeline.STAGES[:-1])
    labels = table(spark, folder, "labels").toPandas()
    assert not set(labels[labels["quality"] == 0]["doc_id"]) <= set(quality["doc_id"])
    kept = quality.sort_values("doc_id").drop_duplicates("text", keep="last")
    assert sorted(exact["doc_id"]) == sorted(kept["doc_id"])
    assert set(near["doc_id"]) <= set(exact["doc_id"]) and near["doc_id"].is_unique
    assert set(mixed["doc_id"]) == set(near["doc_id"]) and len(mixed) >= len(near)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == len(mixed)
