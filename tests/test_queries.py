"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from wayfold.plans import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v if v is None or isinstance(v, bool | int) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.queries()[name](spark, DIR)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted([tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()], key=repr)
    got = sorted([tuple(plain(r[c]) for c in order) for r in df.collect()], key=repr)
    assert got == want
