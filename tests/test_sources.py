"""Sources, sinks and schemas."""

from __future__ import annotations

import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from riverloom.functions.predicates import ConfigError
from riverloom.operators.cdc import apply_changes, change_order, meta, with_meta
from riverloom.operators.outcome import META, Context
from riverloom.sources import sinks, sources, stores, typing
from riverloom.sources.remote import items_of, pages, sheet_records

sys.path.insert(0, os.path.dirname(__file__))


def read(spark, name, config, **context):
    return sources.read(spark, name, config, Context(**context))


def test_csv_is_all_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;y\n1;"a;""b"""\n;2\n')
    out = read(spark, "file", {"path": str(tmp_path / "a.csv"), "delimiter": ";"}).ok
    assert out.dtypes == [("x", "string"), ("y", "string")] and [tuple(r) for r in out.collect()] == [("1", 'a;"b"'), (None, "2")]
    bare = read(spark, "file", {"path": str(tmp_path / "a.csv"), "delimiter": ";", "has_header": False}).ok
    assert bare.columns == ["col_0", "col_1"] and bare.count() == 3
    assert sources.table_name("/x/y/orders.2024.csv") == "orders"


def test_json_lines_and_bad_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\nnot json\n[1]\n{"a": 2.5}\n')
    out = read(spark, "file", {"path": str(tmp_path / "a.jsonl")})
    assert sorted(((r.a, r.b) for r in out.ok.collect()), key=str) == [(1.0, "x"), (2.5, None)]
    assert sorted(json.loads(r.record)["value"] for r in out.errors.collect()) == ["[1]", "not json"]
    typed = read(spark, "file", {"path": str(tmp_path / "a.jsonl"), "schema": "a double"})
    assert typed.ok.columns == ["a"] and typed.errors.count() == 2
    with pytest.raises(ConfigError):
        read(spark, "file", {"path": "x.xml"})
    with pytest.raises(ConfigError):
        read(spark, "fax", {})


def test_demo_and_shards(spark):
    out = read(spark, "demo", {"count": 20, "fields": {"i": "counter", "r": "random", "s": "static:k", "t": "word"}, "shard": {"strategy": "hash_modulo", "key": "i", "total": 3, "index": 1}}).ok

    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) % 2**32
        return h

    assert sorted(r.i for r in out.collect()) == [i for i in range(20) if fnv(str(i)) % 3 == 1]
    assert {(r.s, r.t, r.r == r.i * 7 % 100) for r in out.collect()} == {("k", "word", True)}
    everything = sorted(r.i for k in range(3) for r in read(spark, "demo", {"count": 20, "fields": {"i": "counter"}, "shard": {"strategy": "hash_modulo", "key": "i", "total": 3, "index": k}}).ok.collect())
    assert everything == list(range(20))


def test_jdbc_options():
    got = sources.jdbc_options({"url": "u", "table": "t", "columns": ["a", "id"], "pk": "id", "cursor": 5, "shard_total": 4, "shard_index": 1, "lower": 0, "upper": 9})
    assert got["dbtable"] == "(select a, id from t where id > 5 and MOD(id, 4) = 1) t" and got["partitionColumn"] == "id" and got["numPartitions"] == "8"
    assert sources.jdbc_options({"url": "u", "query": "select 1"})["dbtable"] == "(select * from (select 1) q) t"
    with pytest.raises(ConfigError):
        sources.jdbc_options({"url": "u"})


def messages(spark, values):
    rows = [(b"k" if v != "x" else b'{"payload": {"id": 9}}', None if v is None else v.encode(), "topic", 0, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset long").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))


def decode(spark, values, **config):
    return sources.decode_messages(messages(spark, values), config, Context(node="k"))


def test_messages(spark):
    out = decode(spark, ['{"id": 1}', "x", None], format="json", schema="id long", key_column="kk", expand_key_json=["id"]).ok
    assert [(r.id, r.value, r.kk, r["__key_id"], r._meta.op) for r in out.collect()] == [(1, None, "k", None, "INSERT"), (None, "x", '{"payload": {"id": 9}}', "9", "INSERT"), (None, None, "k", None, "DELETE")]
    bad = decode(spark, ['{"id": 1}', "x", None], format="json", schema="id long", on_parse_error="dlq", tombstone_policy="skip")
    assert bad.ok.count() == 1 and json.loads(bad.errors.first().record)["offset"] == 1
    assert decode(spark, ["x"], format="json", schema="id long", on_parse_error="skip").ok.count() == 0
    env = decode(spark, ['{"payload":{"after":{"id":1},"op":"u","source":{"table":"t"},"ts_ms":0}}', '{"op":"DELETE","table":"q","key":"z","data":{"id":2}}', '{"before":{"id":3},"op":"d"}'], format="envelope", schema="id long").ok
    assert [(r.id, r._meta.op, r._meta.table, r._meta.key) for r in env.collect()] == [(1, "UPDATE", "t", "k"), (2, "DELETE", "q", "z"), (3, "DELETE", "topic", "k")]
    canal = decode(spark, ['{"type":"insert","database":"d","table":"t","data":[{"id":1},{"id":2}]}'], format="canal_json", schema="id long").ok
    assert [(r.id, r._meta.op, r._meta.database) for r in canal.collect()] == [(1, "INSERT", "d"), (2, "INSERT", "d")]
    assert [r.body for r in decode(spark, ["x"], value_column="body").ok.collect()] == ["x"]
    assert [r.value for r in decode(spark, ["x"], format="raw").ok.collect()] == ["x"]


def test_change_files_after_a_snapshot(spark, tmp_path):
    spark.createDataFrame([(1, "old"), (2, "two")], "id long, v string").write.parquet(str(tmp_path / "snap"))
    lines = ['{"payload":{"before":{"id":1},"after":{"id":1,"v":"new"},"op":"u","source":{"db":"d","table":"t"},"ts_ms":5}}', '{"payload":{"op":"t","ts_ms":6}}']
    (tmp_path / "c.json").write_text("\n".join(lines))
    config = {"changes": str(tmp_path / "c.json"), "schema": "id long, v string", "snapshot": str(tmp_path / "snap"), "table": "t"}
    out = read(spark, "mysql_snapshot_cdc", config)
    assert sorted((r.id, r.v, r._meta.op, r._meta.seq) for r in out.ok.collect()) == [(1, "new", "UPDATE", 5), (1, "old", "INSERT", 0), (2, "two", "INSERT", 0)]
    assert [r.message for r in out.errors.collect()] == ["TRUNCATE is not supported"]
    assert read(spark, "postgres_cdc", {**config, "snapshot": None, "truncate": "skip"}).errors.count() == 0


def test_remote_sources(spark):
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "fake_clients.py"))
    base = {"client": "fake_clients:fetch", "schema": "id long, name string, tags string"}
    assert read(spark, "rest_source", {**base, "url": "http://x/pages", "paging": "page", "page_size": 3}).ok.count() == 7
    got = read(spark, "http", {**base, "url": "http://x/all"}).ok.orderBy("id").first()
    assert tuple(got) == (0, "n0", '["a"]')
    keys = read(spark, "redis", {"pattern": "u:*", "client": "fake_clients:FakeRedis", "schema": "key string, name string, value string, values string, members string"}).ok
    assert [tuple(r) for r in keys.orderBy("key").collect()] == [("u:1", "a", None, None, None), ("u:2", None, "text", None, None), ("u:3", None, None, '["x", "y"]', None), ("u:4", None, None, None, '["p", "q"]')]
    assert read(spark, "http", {**base, "url": "http://x/all", "pattern": "not a key of redis"}).ok.count() == 7
    sheet = read(spark, "feishu_sheet", {"url": "http://x/sheet", "client": "fake_clients:fetch", "schema": "id long, name string"}).ok
    assert [tuple(r) for r in sheet.orderBy("id").collect()] == [(1, "a"), (2, "b")]
    some = {"client": "fake_clients:fetch", "schema": "id long", "page_size": 3}
    for name, own in {
        "github": {"repo": "me/it", "token": "t", "base_url": "http://x"},
        "notion": {"database_id": "db", "integration_token": "t", "base_url": "http://x"},
        "salesforce": {"instance_url": "http://x", "login_url": "http://x", "client_id": "a", "client_secret": "b"},
        "stripe": {"secret_key": "t", "base_url": "http://x"},
        "hubspot": {"api_key": "k", "base_url": "http://x"},
    }.items():
        assert sorted(r.id for r in read(spark, name, {**some, **own}).ok.collect()) == list(range(7)), name
    assert read(spark, "hubspot", {**some, "token": "t", "base_url": "http://x"}).ok.count() == 7
    with pytest.raises(ConfigError, match="database_id is required"):
        read(spark, "notion", {**some, "token": "t"})


def test_paging_and_auth():
    from fake_clients import ITEMS, fetch

    flat = lambda **o: [x["id"] for p in pages(o, fetch, lambda s: None) for x in p]
    every = [x["id"] for x in ITEMS]
    assert flat(url="http://x/offset", paging="offset", page_size=3) == every
    assert flat(url="http://x/cursor", paging="cursor", cursor_key="next.at", cursor_param="after", result_key="rows.list") == every
    assert flat(url="http://x/last", paging="last_id", cursor_param="starting_after") == every
    assert flat(url="http://x/private", auth="oauth2", token_url="http://x/token") == every
    assert flat(url="http://x/form", method="POST", body="kind={k}", body_type="form", variables='{"k": "a b"}', result_key="rows") == every[:2]
    assert flat(url="http://x/offset?z=1", paging="offset", page_size=3, max_pages=3) == every
    with pytest.raises(ConfigError, match="more than 2 pages"):
        flat(url="http://x/offset", paging="offset", page_size=3, max_pages=2)
    with pytest.raises(ValueError):
        flat(url="http://x/private")
    with pytest.raises(ConfigError):
        flat(url="http://x/", paging="sideways")
    tries = []

    def down(url, headers, method="GET", body=None):
        tries.append(url)
        raise OSError("down")

    with pytest.raises(OSError):
        list(pages({"url": "http://x/", "max_retries": "2"}, down, lambda s: None))
    assert len(tries) == 2
    assert items_of({"x": 1}, None) == [] and list(sheet_records([[1, 2]])) == [{"col_0": 1, "col_1": 2}]


# ------------------------------------------------------------- sinks


def rows(spark, data, schema="id long, v long", op=None):
    df = spark.createDataFrame(data, schema)
    return with_meta(df, "INSERT" if op is None else op, seq=F.monotonically_increasing_id())


def test_files_leave_deletes_out(spark, tmp_path):
    df = rows(spark, [(1, 1), (2, 2)], op=F.when(F.col("id") == 1, "DELETE").otherwise("INSERT"))
    for kind in ("json", "csv", "parquet", "orc"):
        path = str(tmp_path / kind)
        sinks.write(df, "file_sink", {"path": path, "format": kind})
        back = spark.read.option("header", True).format(kind).load(path)
        assert [(int(r.id), int(r.v)) for r in back.collect()] == [(2, 2)] and META not in back.columns
    with pytest.raises(ConfigError):
        sinks.write(df, "s3", {"path": "x", "format": "xls"})


def test_a_write_is_counted(spark, tmp_path):
    df = rows(spark, [(1, 1), (2, 2), (3, 3)], op=F.when(F.col("id") == 1, "DELETE").otherwise("INSERT"))
    got = sinks.write_observed(df, "file_sink", {"path": str(tmp_path / "o"), "format": "json"})
    assert (got["rows"], got["delete"], got["insert"], got["failed"]) == (3, 1, 2, 0) and got["seconds"] > 0
    two = rows(spark, [(1, 1), (2, 2), (None, 3)]).withColumn(META, meta(op=F.lit("INSERT"), table=F.when(F.col("v") > 1, "b").otherwise("a"), seq=F.col("v")))
    got = sinks.write_observed(two, "table", {"path": str(tmp_path / "t"), "primary_key": "id"}, by_table=True)
    assert got["failed"] == 1 and {t: c["rows"] for t, c in got["by_table"].items()} == {"a": 1, "b": 2}


def test_a_table_takes_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write(rows(spark, [(1, 1), (2, 2)]), "table", {"path": path, "primary_key": "id"})
    ch = spark.createDataFrame([(1, 10, "UPDATE", 1), (2, None, "DELETE", 2), (3, 3, "INSERT", 3)], "id long, v long, op string, s long")
    ch = ch.withColumn(META, meta(op=F.col("op"), seq=F.col("s"))).drop("op", "s")
    sinks.write(ch, "table", {"path": path, "primary_key": ["id"]})
    now, version = sinks.current_version(spark, path)
    assert sorted(map(tuple, now.select("id", "v").collect())) == [(1, 10), (3, 3)] and version == 2
    for _ in range(2):  # the same batch twice
        sinks.write(rows(spark, [(1, 5), (4, 4)]), "table", {"path": path, "primary_key": "id", "mode": "increment", "batch": 7})
    assert sorted(map(tuple, sinks.current_version(spark, path)[0].select("id", "v").collect())) == [(1, 15), (3, 3), (4, 4)]
    drift = rows(spark, [(9, 9, "n")], "id long, v long, note string")
    with pytest.raises(ConfigError):
        sinks.write(drift, "table", {"path": path, "primary_key": "id", "schema_drift": "fail"})
    sinks.write(drift, "table", {"path": path, "primary_key": "id", "schema_drift": "add_columns", "pre_write": {"action": "delete", "condition": "id = ${params.gone}"}, "params": {"gone": 1}})
    now, _ = sinks.current_version(spark, path)
    assert sorted((r.id, r.note) for r in now.collect()) == [(3, None), (4, None), (9, "n")]
    errors = sinks.write(rows(spark, [(None, 1), (3, 30)]), "table", {"path": path, "primary_key": "id"})
    assert [json.loads(r.record)["v"] for r in errors.collect()] == [1]
    aside = str(tmp_path / "t" / ".late")
    drift.write.parquet(aside)
    with pytest.raises(RuntimeError, match="another writer"):
        sinks.publish(spark, aside, f"{path}/v=2")
    assert not os.path.exists(aside)


def test_a_table_in_buckets_replaces_what_changes(spark, tmp_path):
    path = str(tmp_path / "b")
    config = {"path": path, "primary_key": "id", "buckets": 8}
    want = {i: i for i in range(50)}
    sinks.write(rows(spark, list(want.items())), "table", config)
    first = sinks.manifest(spark, path, 1)["folders"]
    assert len(first) == 8
    now = lambda: {r.id: r.v for r in sinks.current_version(spark, path)[0].collect()}
    assert now() == want
    ch = spark.createDataFrame([(7, 70, "UPDATE", 1), (7, None, "DELETE", 2), (60, 60, "INSERT", 3), (None, 1, "INSERT", 4)], "id long, v long, op string, s long")
    ch = ch.withColumn(META, meta(op=F.col("op"), seq=F.col("s"))).drop("op", "s")
    errors = sinks.write(ch, "table", {**config, "batch": 3})
    sinks.write(ch, "table", {**config, "batch": 3})  # once
    del want[7]
    want[60] = 60
    assert now() == want and errors.count() == 1 and sinks.current_version(spark, path)[1] == 2
    second = sinks.manifest(spark, path, 2)["folders"]
    assert sum(first[k] != second[k] for k in first) in (1, 2, 3)
    wider = rows(spark, [(5, 55, "n")], "id long, v long, note string")
    sinks.write(wider, "table", {**config, "schema_drift": "add_columns"})
    assert {r.id: r.note for r in sinks.current_version(spark, path)[0].where("note is not null").collect()} == {5: "n"}
    want[5] = 55
    assert now() == want
    sinks.vacuum(spark, path, keep=1)
    assert now() == want and not sinks.exists(spark, f"{path}/v=1") and not sinks.exists(spark, f"{path}/{first['0']}") or first["0"] in sinks.manifest(spark, path, 3)["folders"].values()
    everything = spark.createDataFrame([(i, None, "DELETE", 100 + i) for i in want], "id long, v long, op string, s long")
    sinks.write(everything.withColumn(META, meta(op=F.col("op"), seq=F.col("s"))).drop("op", "s"), "table", config)
    assert now() == {}


def test_memory_is_for_few_rows(spark):
    sinks.write(spark.range(3), "memory", {"name": "m"})
    assert len(sinks.MEMORY["m"]) == 3
    with pytest.raises(ConfigError, match="more than 2 rows"):
        sinks.write(spark.range(3), "memory", {"limit": 2})


def changes(spark, data):
    df = spark.createDataFrame(data, "id long, v long, name string, op string, s long")
    return df.withColumn(META, meta(op=F.col("op"), seq=F.col("s"), database=F.lit("d"), table=F.lit("T"), ddl=F.when(F.col("op") == "DDL", F.col("name")))).drop("op", "s")


def test_a_database_takes_changes(spark, tmp_path):
    import sqlite3

    db = str(tmp_path / "x.db")
    config = {"table": "t", "primary_key": "id", "connection": {"database": db, "timeout": 60}, "partitions": 3}
    read_ = lambda q="select id, v, name from t order by id": sqlite3.connect(db).execute(q).fetchall()
    first = changes(spark, [(1, 1, "a", "INSERT", 1), (2, 2, "b", "INSERT", 2), (1, 10, "aa", "UPDATE", 3), (None, 0, "lost", "INSERT", 4), (3, 3, "it's", "INSERT", 5)])
    errors = sinks.write(first, "sqlite", {**config, "auto_create": True})
    assert read_() == [(1, 10, "aa"), (2, 2, "b"), (3, 3, "it's")] and [json.loads(r.record)["name"] for r in errors.collect()] == ["lost"]
    gone = changes(spark, [(2, None, None, "DELETE", 6), (3, 5, "c", "UPDATE", 7), (4, 4, "d", "INSERT", 8), (4, 4, "d", "DELETE", 9)])
    for _ in range(2):  # the same changes again change nothing
        sinks.write(gone, "jdbc", {**config, "dialect": "sqlite"})
        assert read_() == [(1, 10, "aa"), (3, 5, "c")]
    more = changes(spark, [(1, 5, "x", "UPDATE", 10), (1, 6, "y", "UPDATE", 11), (9, 9, "n", "INSERT", 12)])
    for _ in range(2):  # a batch is added once
        sinks.write(more, "sqlite", {**config, "mode": "increment", "batch": 4})
    assert read_() == [(1, 21, "y"), (3, 5, "c"), (9, 9, "n")]
    sinks.write(changes(spark, [(1, 0, "z", "INSERT", 1), (7, 7, "n", "INSERT", 2)]), "sqlite", {**config, "mode": "insert"})
    assert read_() == [(1, 21, "y"), (3, 5, "c"), (7, 7, "n"), (9, 9, "n")]
    wider = first.where("id = 3").withColumn("note", F.lit("new"))
    with pytest.raises(ConfigError, match="new columns"):
        sinks.write(wider, "sqlite", {**config, "schema_drift": "fail"})
    sinks.write(wider, "sqlite", {**config, "schema_drift": "add_columns"})
    assert read_("select note from t where id = 3") == [("new",)]
    ddl = changes(spark, [(None, None, "ALTER TABLE t ADD COLUMN later INTEGER", "DDL", 1)])
    with pytest.raises(ConfigError, match="schema change refused"):
        sinks.write(ddl, "sqlite", {**config, "ddl_policy": "reject"})
    sinks.write(ddl, "sqlite", {**config, "ddl_policy": "apply"})
    assert read_("select later from t where id = 3") == [(None,)]
    keyed = with_meta(spark.createDataFrame([(8,)], "v long"), "INSERT", key=F.lit('{"payload": {"id": 3}}'), seq=F.lit(1))
    sinks.write(keyed, "sqlite", {**config, "key_schema": "id long"})
    assert read_("select v from t where id = 3") == [(8,)]
    with pytest.raises(ConfigError, match="does not fit"):
        sinks.write(first, "sqlite", {**config, "target_schema": {"id": "bigint", "v": "bigint", "name": "int"}})
    with pytest.raises(Exception, match="no such table"):
        sinks.write(first, "sqlite", {**config, "table": "absent"})


def test_statements_of_stores():
    s = lambda d, mode, rows=1: stores.insert_statement(stores.DIALECTS[d], "db.t", ["id", "v", "n"], ["id"], mode, rows, ["v"])
    assert s("mysql", "upsert", 2) == "INSERT INTO `db`.`t` (`id`, `v`, `n`) VALUES (%s, %s, %s), (%s, %s, %s) ON DUPLICATE KEY UPDATE `v` = VALUES(`v`), `n` = VALUES(`n`)"
    assert s("mysql", "insert").startswith("INSERT IGNORE INTO")
    assert s("mysql", "increment").endswith("UPDATE `v` = COALESCE(`v`, 0) + COALESCE(VALUES(`v`), 0), `n` = VALUES(`n`)")
    assert s("postgres", "upsert").endswith('ON CONFLICT ("id") DO UPDATE SET "v" = EXCLUDED."v", "n" = EXCLUDED."n"')
    assert s("postgres", "insert").endswith('ON CONFLICT ("id") DO NOTHING')
    assert '"v" = COALESCE("db"."t"."v", 0) + COALESCE(EXCLUDED."v", 0)' in s("postgres", "increment")
    assert s("doris", "upsert") == "INSERT INTO `db`.`t` (`id`, `v`, `n`) VALUES (%s, %s, %s)"
    with pytest.raises(ConfigError):
        s("doris", "increment")
    assert stores.delete_statement(stores.DIALECTS["mysql"], "t`x", ["a", "b"], 2) == "DELETE FROM `t``x` WHERE (`a` = %s AND `b` = %s) OR (`a` = %s AND `b` = %s)"
    assert stores.column_type("clickhouse", "timestamp", False) == "Nullable(DateTime64(3))" and stores.column_type("mysql", "string", True) == "VARCHAR(255)"
    assert stores.column_type("postgres", "decimal(18,2)", False) == "DECIMAL(18,2)"


def test_names_are_served_or_refused(spark, tmp_path):
    df = rows(spark, [(1, 1)])
    for name in ("mysql", "postgres", "clickhouse", "doris"):
        with pytest.raises(Exception, match="no client|No module|no such"):
            sinks.write(df, name, {"table": "t", "primary_key": "id", "path": str(tmp_path / name)})
        assert not (tmp_path / name).exists()
    for name, config in {"redis": {"path": "x"}, "elasticsearch": {"path": "x"}, "maxcompute": {"mode": "append", "path": "x"}, "jdbc": {"mode": "upsert", "table": "t", "url": "u"}}.items():
        with pytest.raises(ConfigError):
            sinks.write(df, name, config)


def test_redis_and_search(spark, tmp_path):
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "fake_clients.py"))
    df = changes(spark, [(1, 1, "a", "INSERT", 1), (1, 2, "b", "UPDATE", 2), (2, 2, "c", "DELETE", 3), (None, 3, "lost", "INSERT", 4)])
    log = tmp_path / "redis.log"
    said = lambda: sorted(json.loads(x) for x in log.read_text().splitlines())
    config = {"client": "fake_clients:FakeRedis", "connection": {"log": str(log)}, "key_field": "id", "key_prefix": "u:", "ttl_seconds": 9, "partitions": 1}
    errors = sinks.write(df, "redis", config)
    assert said() == [["delete", "u:2"], ["expire", "u:1", 9], ["hset", "u:1", {"id": "1", "v": "2", "name": "b"}]] and errors.count() == 1
    log.unlink()
    sinks.write(df, "redis", {**config, "data_type": "string", "value_field": "name"})
    assert said() == [["delete", "u:2"], ["set", "u:1", "b", 9]]
    log.unlink()
    sinks.write(df.where("id = 1"), "redis", {**config, "data_type": "list", "value_field": "name", "ttl_seconds": None})
    assert [json.loads(x) for x in log.read_text().splitlines()] == [["rpush", "u:1", "a"], ["rpush", "u:1", "b"]]
    path = tmp_path / "bulk"
    config = {"client": "fake_clients:bulk", "url": f"http://x{path}", "id_column": "id", "partitions": 1}
    sinks.write(df.where("id is not null"), "es", config)
    lines = [json.loads(x) for x in path.read_text().splitlines()]
    assert lines[:2] == [{"index": {"_index": "t", "_id": "1"}}, {"id": 1, "v": 1, "name": "a"}] and {"delete": {"_index": "t", "_id": "2"}} in lines
    with pytest.raises(Exception, match="items refused"):
        sinks.write(changes(spark, [(1, 1, "refused", "INSERT", 1)]), "elasticsearch", config)


def test_log_order(spark):
    source = lambda **s: json.dumps({"payload": {"source": s, "ts_ms": 5}})
    rising = [source(file="bin.000001", pos=900), source(file="bin.000002", pos=4), source(file="bin.000002", pos=4, row=1), source(file="bin.000010", pos="3")]
    lsn = [source(lsn="0/16B3748"), source(lsn="0/16B3750"), source(lsn="1/0")]
    plain = [source(lsn=23), source(gtid="3e11fa47-71ca:23"), source(), json.dumps({"ts_ms": 7}), "{}", source(pos=12)]
    df = spark.createDataFrame([(x,) for x in [*rising, *lsn, *plain]], "t string")
    got = [r[0] for r in df.select(change_order(F.col("t"))).collect()]
    assert got[:4] == sorted(got[:4]) and len(set(got[:4])) == 4 and got[4:7] == [0x16B3748, 0x16B3750, 1 << 32]
    assert got[7:] == [23, 23, 5, 7, None, 12]
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(source(file="b.1", pos=1 << 33),)], "t string").select(change_order(F.col("t"))).collect()


def test_changes_of_a_rotated_log(spark, tmp_path):
    line = lambda file, pos, v: json.dumps({"payload": {"after": {"id": 1, "v": v}, "op": "u", "source": {"file": file, "pos": pos, "table": "t"}, "ts_ms": 1}})
    (tmp_path / "c.json").write_text("\n".join([line("bin.000001", 900, "old"), line("bin.000002", 4, "new")]))
    out = read(spark, "mysql_cdc", {"changes": str(tmp_path / "c.json"), "schema": "id long, v string"}).ok
    base = out.limit(0).select("id", "v")
    done = apply_changes(base, out.withColumn("seq", F.col("_meta.seq")), ["id"], "seq").ok
    assert [tuple(r) for r in done.collect()] == [(1, "new")]


def test_versions_and_partitions(spark, tmp_path):
    path = str(tmp_path / "v")
    for n in (1, 2):
        sinks.write(spark.createDataFrame([(1, n, n == 2), (n + 1, n, False)], "id long, _version long, gone boolean"), "table", {"path": path, "mode": "versions"})
    final = sinks.final_view(spark.read.parquet(path), ["id"], deleted="gone")
    assert sorted(r.id for r in final.collect()) == [2, 3]
    path = str(tmp_path / "p")
    config = {"path": path, "mode": "partition_overwrite", "partition_by": ["d"]}
    sinks.write(spark.createDataFrame([(1, "a"), (2, "b")], "id long, d string"), "odps", config)
    sinks.write(spark.createDataFrame([(3, "b")], "id long, d string"), "maxcompute", config)
    assert sorted((r.id, r.d) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]
    with pytest.raises(Exception, match="partition value d is missing"):
        sinks.write(spark.createDataFrame([(4, None)], "id long, d string"), "odps", config)


def test_pre_write(spark):
    from datetime import date

    base = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id long, d string")
    left = lambda c: sorted(r.id for r in sinks.pre_write(base, c, date(2024, 1, 2), {"x": "2024-01-01"}).collect())
    assert left({"action": "delete", "condition": "d = '${PROCESSING_DATE}'"}) == [1]
    assert left({"action": "truncate"}) == [] and left(None) == [1, 2]
    assert left({"action": "truncate_partition", "partition": {"d": "${params.x}"}}) == [2]
    with pytest.raises(ConfigError):
        left({"action": "burn"})


def test_outgoing_messages(spark):
    df = with_meta(spark.createDataFrame([(1, "x")], "id long, v string"), "UPDATE", database=F.lit("d"), table=F.lit("t"), key=F.lit("kk"), ts=F.lit("2024-01-01").cast("timestamp"), seq=F.lit(3))
    (m,) = sinks.messages(df, {"topic_template": "cdc.{database}.{table}"}).collect()
    assert (m.topic, m.key) == ("cdc.d.t", "kk")
    body = json.loads(m.value)
    assert body["after"] == {"id": 1, "v": "x"} and body["op"] == "u" and body["source"] == {"db": "d", "table": "t"} and body["ts_ms"] == 1704067200000
    (m,) = sinks.messages(df, {"topic": "t", "format": "json", "key_column": "id"}).collect()
    assert (m.topic, m.key, json.loads(m.value)) == ("t", "1", {"id": 1, "v": "x"})
    back = sources.decode_messages(messages(spark, [json.dumps(body)]), {"format": "envelope", "schema": "id long, v string"}).ok.first()
    assert (back.id, back.v, back._meta.op, back._meta.table) == (1, "x", "UPDATE", "t")
    assert df.select(stores.document_id(df)).first()[0] == df.select(stores.document_id(df)).first()[0] and df.select(stores.document_id(df, "id")).first()[0] == "1"


def test_types(spark):
    assert [typing.family(t) for t in ("Nullable(Int64)", "VARCHAR(9)", "bigint unsigned", "LowCardinality(Nullable(String))", "Array(Int8)", "odd", "", "datetime(3)")] == ["int", "string", "int", "string", "json", "unknown", "", "time"]
    assert typing.compatible("int", "Decimal(9,2)") and typing.compatible("date", "datetime") and not typing.compatible("varchar(3)", "int") and typing.compatible("odd", "int")
    assert [typing.hinted(n) for n in ("id", "user_id", "is_new", "deleted", "deleted_at", "order_total", "email", "payload", "colour")] == ["bigint", "bigint", "boolean", "boolean", "timestamp", "decimal(18,2)", "string", "string", None]
    assert [typing.source_type(t) for t in ("decimal(10,3)", "numeric(99,2)", "int8", "io.debezium.time.Date", "enum('a')")] == ["decimal(10,3)", "decimal(38,10)", "bigint", "date", "string"]
    df = spark.createDataFrame([("5", "x", "1.5", "2024-01-01"), ("6", "7", None, "2024-01-02 10:00:00")], "id string, user_id string, amount string, made_at string")
    assert typing.resolve(df, {"id": "int"}, {"made_at": "date"}) == {"id": "bigint", "user_id": "string", "amount": "decimal(18,2)", "made_at": "date"}
    assert typing.mismatches(df, {"id": "varchar(9)", "user_id": "int", "amount": "text"}) == ["user_id: string does not fit int", "made_at: not in the target"]
