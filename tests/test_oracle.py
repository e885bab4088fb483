"""Every query that has SQL gives DuckDB's rows over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from hyperloom.plans import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    text = lambda v: "null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_same_rows(spark, con, name):
    got, want = engine.QUERIES[name](spark, SF).toPandas(), con.execute(engine.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "edge_id" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
