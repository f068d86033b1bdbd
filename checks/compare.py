"""Run queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import duckdb
from pyspark.sql import SparkSession

from checks.fixtures import TABLES
from checks.oracle import ORACLE
from checks.queries import QUERIES


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _rows(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(row[i] for i in order) for row in rows), key=lambda r: [(v is None, str(v)) for v in r]
    )


def expected(con: duckdb.DuckDBPyConnection, name: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(ORACLE[name])
    return _rows([d[0] for d in cursor.description], cursor.fetchall())


def actual(spark: SparkSession, sf_dir: str, name: str) -> tuple[list[str], list[tuple]]:
    df = QUERIES[name](spark, sf_dir)
    return _rows(df.columns, df.collect())


def difference(spark: SparkSession, con, sf_dir: str, name: str) -> str | None:
    """None when both agree, else what differs."""
    want_names, want = expected(con, name)
    names, rows = actual(spark, sf_dir, name)
    if names != want_names:
        return f"columns {names} instead of {want_names}"
    if rows == want:
        return None
    extra, missing = set(rows) - set(want), set(want) - set(rows)
    return f"{len(rows)} rows instead of {len(want)}; extra {list(extra)[:2]}; missing {list(missing)[:2]}"
