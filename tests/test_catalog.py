import duckdb
import pytest

import __spark_entry__ as entry
from linewright import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif "float" in str(df[c].dtype):
            df[c] = df[c].map(lambda x: repr(round(float(x), 5) + 0.0))
    return sorted(map(tuple, df.astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(name, spark, duck):
    got, want = catalog.queries()[name](spark, DIR).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_prune_columns(spark):
    plan = catalog.queries()["semi_join_sample"](spark, DIR)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in plan and "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)" in plan
