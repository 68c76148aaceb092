"""The queries that have DuckDB checks, against these, on the smallest shared tables."""

import duckdb
import pytest

import __spark_entry__
from almanac.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    wanted = con.sql(ORACLES[name])
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(wanted.columns)
    rows = lambda found, columns: sorted(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in found)
    assert rows(got.collect(), got.columns) == rows(wanted.fetchall(), list(wanted.columns))
