"""Every query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from riverloom import queries as base

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return ("number", round(v, 6))
    return (type(v).__name__, str(v))


@pytest.mark.parametrize("name", sorted(base.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = base.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(base.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


def test_queries_without_sql(spark):
    assert 0 < base.queries()["sample_bernoulli"](spark, SF).count() < 300

    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) % 2**32
        return h

    users = {r.event_id: r.user_id for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    assert all(r.hash == fnv(f"{r.event_type}-{users[r.event_id]}") for r in base.queries()["hash_shard"](spark, SF).collect())
    ring, kept = [], []
    for i in sorted(users):
        if users[i] not in ring:
            ring = [*ring, users[i]][-50:]
            kept.append((i, users[i]))
    assert sorted(tuple(r) for r in base.queries()["deduplicate_ring"](spark, SF).collect()) == kept


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
