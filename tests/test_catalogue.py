import os

import duckdb
import pytest

from sluice.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    assert got
    if name in ORACLES:
        out = db.execute(ORACLES[name])
        names = [x[0] for x in out.description]
        assert sorted(names) == columns
        want = sorted((tuple(r[names.index(c)] for c in columns) for r in out.fetchall()), key=repr)
        assert len(got) == len(want)
        assert [x for x in zip(got, want) if x[0] != x[1]][:2] == []
