import os

import duckdb
import pytest

from sluice.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    out = con.execute(ORACLES[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in out.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == want


def test_one_query_for_each_operator():
    assert sorted(int(x[2:].split("_")[0]) for x in QUERIES) == list(range(1, len(QUERIES) + 1))
