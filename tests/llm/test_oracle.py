"""Queries of the training-data operators against their SQL."""

import duckdb
import pytest

from gleanwork.llm.oracle import ORACLE
from gleanwork.llm.queries import QUERIES

TABLES = ("documents", "embeddings", "labels")


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall(), key=repr)
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(row) for row in df.select(*names).collect()), key=repr)
    assert got == want
