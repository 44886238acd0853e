"""Every query of the catalog and raster operators against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pagemill.plans import catalog_queries, kernel_queries, pixel_queries

ALL = catalog_queries.QUERIES | pixel_queries.QUERIES | kernel_queries.QUERIES
SQL = catalog_queries.SQL | pixel_queries.SQL | kernel_queries.SQL


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in found), key=lambda t: [(x is None, str(x)) for x in t])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    df = ALL[name](spark, sf_dir)
    db = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    want = db.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert ALL[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
