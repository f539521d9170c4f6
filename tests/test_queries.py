"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from graphloom.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if pd.isna(x) else float(x) if isinstance(x, (int, float)) else str(x) for x in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    assert len(a) > 0
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-6) if all(isinstance(z, float) for z in x) else [pytest.approx(z, abs=2e-6) if isinstance(z, float) else z for z in y] == list(x)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10 * len(range(0, spark.read.parquet(f"{sf}/embeddings.parquet").count(), 20))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
