"""Every registered query equals its DuckDB oracle at sf0.001 (order-insensitive)."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and v != v) else (round(v, 9) if isinstance(v, float) else v))
    return sorted(map(tuple, df.astype(str).values.tolist()))


def test_every_query_has_an_oracle():
    assert set(entry._CORE) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["message_id", "table_idx", "row_idx", "name", "rate", "entry"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_query_matches_oracle(spark, con, name):
    a = entry.queries()[name](spark, SF).toPandas()
    b = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    assert _norm(a) == _norm(b)
