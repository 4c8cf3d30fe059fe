"""Every registered query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from rankloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(cell, r)) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert rows(plans.queries()[name](spark, SF).toPandas()) == rows(con.execute(plans.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["hybrid_rrf", "entity_projection", "nearest_event", "bm25_query_tf"])
def test_partitions_do_not_matter(spark, name):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = rows(plans.queries()[name](spark, SF).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == rows(plans.queries()[name](spark, SF).toPandas())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
