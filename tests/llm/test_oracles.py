"""The corpus queries that have SQL against it."""

import duckdb
import pytest

from rankloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    rows = lambda f: sorted(f[names].itertuples(index=False, name=None))
    assert rows(got) == rows(want)
