"""Every registered query of the engine runs, and gives what its SQL gives."""

import math
import os

import duckdb
import pytest

from sparkfeat import queries as qs

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(qs.QUERIES))
def test_query(spark, db, name):
    df = qs.QUERIES[name](spark, DIR)
    got = [tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()]
    if name not in qs.SQL:
        assert got or name in ()
        return
    cur = db.execute(qs.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    at = sorted(range(len(cols)), key=lambda k: cols[k])
    want = [tuple(plain(r[k]) for k in at) for r in cur.fetchall()]
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(sorted(got, key=repr), sorted(want, key=repr)) if a != b]
    assert not bad, bad[:2]
