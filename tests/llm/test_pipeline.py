"""The pipeline and the registered queries of the subpackage."""

import duckdb
import pytest

import corpus_pipeline
from graphloom.llm.queries import ORACLE_SQL, QUERIES


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES][0].startswith("quality") and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchall()
    cols = [d[0] for d in con.description]
    got = [tuple(r) for r in QUERIES[name](spark, sf).select(*cols).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = corpus_pipeline.materialize(out, f"test-{i}")
        assert 0 < docs.count() <= n
        n = docs.count()
    mixed = corpus_pipeline.materialize(corpus_pipeline.STAGES[3][1](spark, docs, sf), "test-mix")
    last = corpus_pipeline.STAGES[4][1](spark, mixed, sf)
    assert last.count() == mixed.count() > 0


def test_stage_on_an_empty_table(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
