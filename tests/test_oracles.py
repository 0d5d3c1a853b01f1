"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from sparrowlog.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cur = db.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    want = sorted(tuple(norm(dict(zip(names, row))[c]) for c in columns) for row in cur.fetchall())
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert "hunter_name" in rows.columns
    rows.collect()
