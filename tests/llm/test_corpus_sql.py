"""Corpus queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from riverloom.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.sql(oracles.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == sorted(str(tuple(r)) for r in found.fetchall())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.queries()} == {*(f"op{k}" for k in range(1, 11)), "pipeline"}
