"""Every registered query of the operators runs, and equals its SQL where it has one."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from gridloom.plans.registry import QUERIES, SQL

entry._reference()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df):
    def value(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return None
        if isinstance(v, (float, np.floating)):
            return int(v) if float(v).is_integer() and abs(v) < 1e15 else float(v)
        return int(v) if isinstance(v, (int, np.integer, bool, np.bool_)) else str(v)

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(value, row))) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    if name not in SQL:
        # Values of these are held against numpy in test_values.py or on fixtures; here they must give some.
        rows = got.toPandas()
        assert len(rows) and not rows.isna().all().any()
        return
    assert plain(got.toPandas()) == plain(db.sql(SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
