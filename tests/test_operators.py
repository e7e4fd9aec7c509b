"""Operators one by one: what they keep, change, drop and fail."""

from __future__ import annotations

import json
import datetime

import pytest
from pyspark.sql import functions as F

from riverloom.functions.predicates import ConfigError
from riverloom.operators.cdc import apply_changes, key_from_metadata, meta, translate_ddl
from riverloom.operators.code import plugin
from riverloom.operators.joins import Snapshots, small
from riverloom.operators.outcome import META, Context, apply, classify, retryable
from riverloom.operators.project import fnv32, fnv64
from riverloom.plans.compile import chain, dry_run


def rows(df):
    return [tuple(r) for r in df.collect()]


def ok(df, name, config=None, **context):
    return apply(df, name, config or {}, Context(**context)).ok


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Ann", 3.0, None), (2, "Bob", None, "x"), (3, None, 0.0, "")], "id int, name string, score double, tag string")


def test_unknown_operators_and_bad_configurations(people):
    for name, config in [
        ("nothing", {}),
        ("coalesce", {"fields": ["a"]}),
        ("rename", {}),
        ("cast", {"fields": {"id": "int"}, "on_error": "maybe"}),
        ("sample", {"rate": 2}),
        ("limit", {}),
        ("limit", {"n": 1.5}),
        ("window", {"window_type": "sliding"}),
        ("window", {"aggregates": [{"func": "median", "field": "score"}], "event_time": "id"}),
        ("join", {"join_key": "id", "join_fields": ["name"], "join_type": "right", "seq": "id"}),
        ("join", {"join_key": "id", "join_fields": ["name"], "join_type": "full", "seq": "id"}),
        ("join", {"join_key": "id", "join_fields": ["name"]}),
        ("lookup", {"table": "absent", "key": "id"}),
        ("extract", {"rules": [{"target": "x", "pattern": "a", "template": "b"}]}),
        ("extract", {"rules": [{"target": "name", "pattern": "a", "group": 2}]}),
        ("extract", {"rules": [{"target": "x", "template": "{{if .name}}a{{end}}"}]}),
        ("validate", {"rules": [{"field": "id", "type": "prime"}]}),
        ("python", {"script": "record.x = 1"}),
        ("plugin_absent", {}),
        ("project", {"mappings": {"id": "x", "name": "x"}}),
        ("deduplicate", {"keys": ["id"]}),
    ]:
        with pytest.raises(ConfigError):
            apply(people, name, config)


def test_project_orders_its_effects(people):
    out = ok(people, "project", {"fields": ["id", "absent"], "mappings": {"name": "id2", "tag": "t"}, "constants": {"t": "c", "n": 1}})
    assert out.columns == ["id", "id2", "t", "n"] and rows(out)[0] == (1, "Ann", "c", 1)
    moved = ok(people, "project", {"keep_unmapped": True, "mappings": {"name": "tag"}})
    assert moved.columns == ["id", "score", "tag"] and rows(moved)[1] == (2, None, "Bob")


def test_project_fails_rows_without_a_time(spark):
    df = spark.createDataFrame([(1, "2024-01-02"), (2, "soon"), (3, None)], "id int, at string")
    out = apply(df, "select_fields", {"fields": ["id", "at"], "time_formats": {"at": "unix"}}, Context(node="p"))
    assert rows(out.ok) == [(1, 1704153600), (3, None)]
    assert [(r.node, r.error_class, r.message, r.record) for r in out.errors.collect()] == [("p", "data", "project: at is not a time", '{"id":2,"at":"soon"}')]


def test_add_field_knows_the_time(people):
    now = F.lit(datetime.datetime(2024, 5, 1, 12, 0, 0))
    assert rows(ok(people, "add_field", {"field": "t", "value": "{{now}}"}, now=now).select("t"))[0] == ("2024-05-01T12:00:00Z",)
    assert rows(ok(people, "add_field", {"field": "t", "value": "{{ts}}"}, now=now).select("t"))[0] == (1714564800,)
    assert rows(ok(people, "add_field", {"field": "t", "value": 5}).select("t"))[0] == ("5",)


def test_coalesce_skips_what_is_empty(people):
    out = ok(people, "coalesce", {"fields": ["tag", "name", "absent"], "target_field": "first"})
    assert [r.first for r in out.collect()] == ["Ann", "x", None]
    mixed = ok(people, "coalesce", {"fields": ["score", "name"], "target_field": "name"})
    assert [r.name for r in mixed.collect()] == ["3", "Bob", None]


def test_extract_leaves_what_does_not_match(people):
    rules = [{"target": "name", "pattern": "^A(n+)", "group": 1}, {"target": "n", "source_field": "id", "pattern": "1"}, {"target": "l", "template": "{{.name}}-{{ .absent }}"}]
    assert [(r.name, r.n, r.l) for r in ok(people, "extract", {"rules": rules}).collect()] == [("nn", None, "nn-<no value>"), ("Bob", None, "Bob-<no value>"), (None, None, "<nil>-<no value>")]


def test_masks(spark):
    df = spark.createDataFrame([("13812345678", "user@example.com", "110101199001011234", "abc"), ("123", "a@b", "short", "é")], "p string, e string, i string, h string")
    out = ok(df, "mask", {"fields": {"p": "mask_phone", "e": "mask_email", "i": "mask_id_card", "h": "hash"}})

    def fnv(s):
        h = 14695981039346656037
        for c in s:
            h = ((h ^ ord(c)) * 1099511628211) % 2**64
        return f"{h:x}"

    got = rows(out)
    assert [g[:3] for g in got] == [("138****5678", "u***@example.com", "110***********1234"), ("****", "****", "****")]
    assert [g[3] for g in got] == [fnv("abc"), fnv("é")]


def test_fnv_of_any_text(spark):
    texts = ["", "a", "foobar", "é日本", "x" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")

    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) % 2**32
        return h

    assert [r[0] for r in df.select(fnv32(F.col("t"))).collect()] == [fnv(t) for t in texts]
    assert df.select(fnv64(F.col("t")).alias("h")).first().h == 14695981039346656037 - 2**64


def test_validate_collects_or_stops(people):
    rules = {"required_fields": ["name", "absent"], "rules": [{"field": "score", "type": "range", "max": 2}]}
    bad = apply(people, "validate", rules).errors.collect()
    assert [r.message for r in bad] == ["absent: required; score: range", "absent: required; score: range", "name: required; absent: required"]
    assert [r.message for r in apply(people, "validate", {**rules, "fail_immediate": True}).errors.collect()] == ["absent: required", "absent: required", "name: required"]
    assert apply(people, "validate", {**rules, "on_failure": "drop"}).errors is None


def test_validate_knows_its_ways(people):
    rules = {"required_fields": ["name"]}
    assert apply(people, "validate", {**rules, "on_failure": "dlq"}).errors.count() == 1
    with pytest.raises(ConfigError):
        apply(people, "validate", {**rules, "on_failure": "ignore"})


def test_validate_counts_bytes(spark):
    df = spark.createDataFrame([("héllo", [1, 2])], "s string, a array<int>")
    rule = lambda f, t, **k: {"rules": [{"field": f, "type": t, **k}]}
    assert ok(df, "validate", rule("s", "length_min", min=6)).count() == 1
    assert ok(df, "validate", rule("s", "range", max=5)).count() == 0
    assert ok(df, "validate", rule("a", "length_max", max=2)).count() == 1


def test_deduplicate_keeps_first_and_null_is_a_key(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", 3), (None, 4), ("b", 5)], "k string, seq int").repartition(3)
    assert sorted(rows(ok(df, "deduplicate", {"keys": ["k"], "seq": "seq"})), key=str) == [("a", 1), ("b", 5), (None, 2)]
    with_map = df.withColumn("m", F.create_map(F.lit("x"), F.col("seq")))
    assert ok(with_map, "deduplicate", {"keys": ["k"], "seq": "seq"}).count() == 3


def test_a_ring_forgets(spark):
    keys = [1, 2, 1, 3, 1, 2, 4, 5, 1]
    df = spark.createDataFrame(list(enumerate(keys)), "seq int, k int").repartition(4)
    got = ok(df, "deduplicate", {"keys": ["k"], "exact_window": True, "window_size": 2, "seq": "seq"})
    kept, ring = [], []
    for i, k in enumerate(keys):
        if k not in ring:
            ring = [*ring, k][-2:]
            kept.append((i, k))
    assert sorted(rows(got)) == kept


def test_sort_puts_nulls_first_and_last(people):
    assert [r.id for r in ok(people, "sort", {"fields": ["score"]}).collect()] == [2, 3, 1]
    assert [r.id for r in ok(people, "sort", {"fields": [{"field": "score", "order": "desc"}]}).collect()] == [1, 3, 2]
    assert [r.id for r in chain(people, [("sort", {"fields": ["id"]}), ("skip", {"n": 1}), ("limit", {"n": 1})]).ok.collect()] == [2]


@pytest.mark.parametrize("down", [False, True])
def test_skip_needs_no_single_task(spark, down):
    data = [(i, None if i % 9 == 0 else i * 7919 % 101) for i in range(500)]
    df = spark.createDataFrame(data, "i int, v int").repartition(6)
    fields = [{"field": "v", "order": "desc" if down else "asc"}]
    ordered = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]) if down else (r[1] is not None, r[1] or 0, r[0]))
    for n in (0, 1, 55, 56, 57, 250, 499, 500, 900):
        out = chain(df, [("sort", {"fields": fields, "seq": "i"}), ("skip", {"n": n})]).ok
        assert rows(out) == ordered[n:], n
        if 0 < n < 500:
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SinglePartition" not in plan and "GlobalLimit" not in plan
    assert ok(df, "skip", {"n": 20}).count() == 480
    page = chain(df, [("sort", {"fields": fields, "seq": "i"}), ("skip", {"n": 100}), ("limit", {"n": 10})]).ok
    assert rows(page) == ordered[100:110]


def test_compaction_scans_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = ok(df, "compact", {"keys": ["l_orderkey"], "seq": "l_linenumber"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_compaction_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 3, "c"), (None, 4, "d")], "k int, seq int, v string")
    assert sorted(rows(ok(df, "compact", {"keys": ["k"], "seq": "seq"})), key=str) == [(1, 2, "b"), (None, 3, "c"), (None, 4, "d")]


def test_windows_without_values(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:10", None, 1), ("2024-01-01 00:00:50", "x", 2), ("2024-01-01 00:01:00", "2.5", 3)], "at string, v string, n int")
    config = {"event_time": "at", "window_size_seconds": 60.0, "seq": "n", "aggregates": [{"func": "sum", "field": "v"}, {"func": "avg", "field": "v"}, {"func": "count"}, {"func": "first", "field": "v"}, {"func": "last", "field": "v"}]}
    got = sorted(rows(ok(df, "window", config)))
    assert got == [("2024-01-01T00:00:00Z", "2024-01-01T00:01:00Z", 0.0, 0.0, 2, "x", "x"), ("2024-01-01T00:01:00Z", "2024-01-01T00:02:00Z", 2.5, 2.5, 1, "2.5", "2.5")]


def asof_model(data, span, where=lambda r: True):
    out, seen = [], {}
    for seq, key, t, v in data:
        hit = seen.get(key)
        good = key not in (None, "") and hit is not None and t - hit[0] < span
        out.append((seq, hit[1] if good else None))
        if key not in (None, "") and where(v):
            seen[key] = (t, v)
    return out


@pytest.mark.parametrize("sliced", [None, 1, 7])
def test_asof_join_is_a_loop_over_rows(spark, sliced):
    import random

    rng = random.Random(3)
    data, t = [], 0
    for seq in range(300):
        t += rng.choice([0, 1, 3, 9, 20, -15])  # times and order may disagree
        data.append((seq, rng.choice(["a", "b", "c", "", None]), t, rng.randint(0, 9)))
    df = spark.createDataFrame(data, "seq int, key string, t int, v int").repartition(4)
    config = {"join_key": "key", "join_fields": ["v"], "join_window_sec": 20, "event_time": "t", "seq": "seq", "join_type": "left"}
    if sliced:
        config["slices"] = sliced
    assert sorted((r.seq, r.joined_v) for r in ok(df, "join", config).collect()) == asof_model(data, 20)
    some = ok(df, "join", {**config, "where": "v >= 5"})
    assert sorted((r.seq, r.joined_v) for r in some.collect()) == asof_model(data, 20, lambda v: v >= 5)
    inner = apply(df, "join", {**config, "join_type": "inner", "on_miss": "dlq"})
    want = asof_model(data, 20)
    assert inner.ok.count() == sum(v is not None for _, v in want) and inner.errors.count() == sum(v is None for _, v in want)


def test_joins_refuse_more_than_they_may_hold(spark):
    df = spark.createDataFrame([(i, f"k{i % 3}", i) for i in range(10)] + [(11, None, 1)], "seq int, key string, t int")
    config = {"join_key": "key", "join_fields": ["t"], "event_time": "t", "seq": "seq"}
    assert apply(df, "join", {**config, "max_buffered_keys": 3, "max_buffered_records": 10}, Context()).ok.count() == 7
    with pytest.raises(ConfigError, match="state key limit exceeded"):
        apply(df, "join", {**config, "max_buffered_keys": 2}, Context())
    with pytest.raises(ConfigError, match="state record limit exceeded"):
        apply(df, "join", {**config, "max_buffered_records": 9}, Context())


def test_dimensions_with_several_rows_ask_for_an_order(spark, people):
    config = {"table": "d", "key": "id", "dim_key": "k", "fields": ["name"]}
    twice = spark.createDataFrame([(1, "one"), (1, "one"), (2, None), (2, None)], "k int, name string")
    assert ok(people, "lookup", config, tables={"d": twice}).where("id = 1").first().name == "one"
    several = spark.createDataFrame([(1, "one"), (1, "uno")], "k int, name string")
    with pytest.raises(Exception, match="dim_order is required"):
        ok(people, "lookup", config, tables={"d": several}).collect()


def test_broadcasts_are_checked_by_rows_and_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "i int, t string")
    assert small(df) and not small(df, most=49) and not small(df, most_bytes=10_000)


def test_queries_with_several_conditions(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "x")], "a int, b string")
    dim = spark.createDataFrame([(1, "x", 10, "on"), (1, "y", 20, "off"), (2, "x", 30, "on"), (2, "x", 31, "off")], "k int, l string, v int, s string")
    config = {"mode": "query", "query": "select v from d where k = {{.a}} and s = 'on' and l = {{.b}}", "fields": ["v"], "on_miss": "null"}
    got = ok(df, "lookup", config, tables={"d": dim})
    assert sorted(((r.a, r.b, r.v) for r in got.collect()), key=str) == [(1, "x", 10), (1, "y", None), (2, "x", 30), (None, "x", None)]
    both = ok(df, "lookup", {"table": "d", "key": ["a", "b"], "dim_key": ["k", "l"], "fields": ["v"], "dim_order": "v"}, tables={"d": dim})
    assert sorted(((r.a, r.b, r.v) for r in both.collect()), key=str) == [(1, "x", 10), (1, "y", 20), (2, "x", 31), (None, "x", None)]
    rows_ = ok(df, "enricher", {"query": "select v from d where k = {{.a}} and l = '{{.b}}'", "target_field": "f"}, tables={"d": dim})
    assert sorted([(r.a, r.b, [x.v for x in r.f]) for r in rows_.collect()], key=str) == [(1, "x", [10]), (1, "y", [20]), (2, "x", [30, 31]), (None, "x", [])]
    for bad in ("select v from d where k > {{.a}}", "select v from d where s = 'on'", "select v from d where k = {{.a}} order by v"):
        with pytest.raises(ConfigError):
            apply(df, "lookup", {**config, "query": bad}, Context(tables={"d": dim}))


def test_dimensions_are_loaded_again(spark, people):
    now, state = [0.0], {"rows": [(1, "a")], "down": False}

    def load():
        if state["down"]:
            raise OSError("down")
        return spark.createDataFrame(state["rows"], "k int, name string")

    context = Context(tables={"d": load}, snapshots=Snapshots(lambda: now[0]))
    config = {"table": "d", "key": "id", "dim_key": "k", "fields": ["name"], "refresh_interval_sec": 10}
    first = lambda **more: apply(people, "lookup", {**config, **more}, context).ok.where("id = 1").first().name
    assert first() == "a"
    state["rows"] = [(1, "b")]
    assert first() == "a"  # not old enough
    now[0] = 11
    assert first() == "b"
    state["down"], now[0] = True, 30
    assert first() == "b" and context.snapshots.failures == 1  # the last good state
    with pytest.raises(ConfigError, match="refresh of d failed"):
        first(on_refresh_error="error")
    with pytest.raises(ConfigError, match="on_refresh_error"):
        first(on_refresh_error="sometimes")
    with pytest.raises(ConfigError):
        apply(people, "lookup", config, Context(tables={"d": load}))


def test_lookup_policies(spark, people):
    dim = spark.createDataFrame([(1, "one", 1), (1, "uno", 2), (None, "none", 3), (3, None, 4)], "k int, name string, v int")
    config = {"table": "d", "key": "id", "dim_key": "k", "fields": ["name"], "dim_order": "v"}
    tables = {"d": dim}
    names = lambda df: [r.name for r in df.orderBy("id").collect()]
    assert names(ok(people, "lookup", config, tables=tables)) == ["uno", "Bob", None]
    assert names(ok(people, "lookup", {**config, "on_miss": "null"}, tables=tables)) == ["uno", None, None]
    out = apply(people, "lookup", {**config, "on_miss": "error"}, Context(tables=tables))
    assert names(out.ok) == ["uno", None] and out.errors.count() == 1
    with pytest.raises(ConfigError):
        apply(people, "lookup", {**config, "max_cache_entries": 1}, Context(tables=tables))


def test_http_enricher(people):
    def fetch(url, headers, timeout):
        if url.endswith("/2"):
            raise ValueError("no such row")
        return '{"url": "%s"}' % url

    config = {"mode": "http", "url": "http://x/{{.id}}", "client": "f", "target_field": "got", "on_error": "error", "retry_delay_sec": 0}
    out = apply(people, "enricher", config, Context(functions={"f": fetch}))
    assert sorted((r.id, r.got) for r in out.ok.collect()) == [(1, '{"url": "http://x/1"}'), (3, '{"url": "http://x/3"}')]
    assert [r.message for r in out.errors.collect()] == ["enricher: no such row"]
    kept = apply(people, "enricher", {**config, "on_error": "pass"}, Context(functions={"f": fetch}))
    assert kept.ok.count() == 3 and kept.errors is None


def test_http_values_are_encoded(spark):
    df = spark.createDataFrame([("a b&x=1/?#é", "t\r\nX: y"), (None, None)], "q string, h string")

    def fetch(url, headers, timeout):
        return json.dumps({"url": url, "h": headers["X-H"]})

    config = {"mode": "http", "url": "http://x/s?q={{.q}}", "headers": {"X-H": "v {{.h}}"}, "client": "f", "target_field": "got"}
    got = [json.loads(r.got) for r in ok(df, "enricher", config, functions={"f": fetch}).collect()]
    assert got == [{"url": "http://x/s?q=a%20b%26x%3D1%2F%3F%23%C3%A9", "h": "v t X: y"}, {"url": "http://x/s?q=", "h": "v "}]
    with pytest.raises(ConfigError):
        apply(df, "enricher", {**config, "url": "http://x/{{.absent}}"}, Context(functions={"f": fetch}))


def test_functions_over_rows(people):
    def f(row):
        if row["id"] == 1:
            raise RuntimeError("bad row")
        return None if row["id"] == 2 else [{"id": row["id"], "part": p} for p in "ab"]

    config = {"function": "f", "schema": "id int, part string"}
    out = apply(people, "udtf", config, Context(functions={"f": f}))
    assert rows(out.ok) == [(3, "a"), (3, "b")]
    (bad,) = out.errors.collect()
    assert bad.message == "RuntimeError: bad row" and '"id": 1' in bad.record
    assert apply(people, "udtf", {**config, "on_error": "drop"}, Context(functions={"f": f})).errors is None
    same = apply(people, "lua", {"function": "g"}, Context(functions={"g": lambda r: r["id"] != 2}))
    assert [r.id for r in same.ok.collect()] == [1, 3]


def test_explode_of_structs_and_plugins(spark, people):
    df = spark.createDataFrame([(1, [(10, "a"), (20, "b")]), (2, [])], "id int, items array<struct<n:int,s:string>>")
    assert rows(ok(df, "flat_map", {"explode": "items"})) == [(1, 10, "a"), (1, 20, "b")]

    @plugin("upper")
    def upper(df, config):
        return df.withColumn(config["field"], F.upper(config["field"]))

    assert [r.name for r in ok(people, "plugin_upper", {"field": "name"}).collect()] == ["ANN", "BOB", None]


def test_sources_and_sinks_of_plugins(spark):
    from riverloom.plans.compile import run

    got = []
    plugin("few", kind="source")(lambda spark, config: spark.range(config["n"]))
    plugin("list", kind="sink")(lambda df, config: got.extend(r.id for r in df.collect()))
    run(spark, {"name": "p", "source": {"type": "plugin_few", "config": {"n": 3}}, "sink": {"type": "plugin_list"}})
    assert got == [0, 1, 2]
    for kind in ("source", "sink"):
        spec = {"name": "p", "source": {"type": "demo"}, "sink": {"type": "memory"}} | {kind: {"type": "plugin_absent"}}
        with pytest.raises(ConfigError):
            run(spark, spec)
    with pytest.raises(ConfigError):
        plugin("x", kind="hook")
    with pytest.raises(ConfigError):
        plugin("x", abi=2)


def test_sql_leaves_hidden_columns_out(people):
    out = ok(people.withColumn("_x", F.lit(1)), "sql", {"query": "select * from input where id > 1"})
    assert out.columns == ["id", "name", "score", "tag"] and out.count() == 2


def change(spark, data):
    df = spark.createDataFrame(data, "op string, seq long, k int, v int")
    return df.withColumn(META, meta(op=F.col("op"), seq=F.col("seq"))).drop("op")


def test_changes_lead_to_a_table(spark):
    base = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, v int")
    ch = change(spark, [("UPDATE", 1, 1, 11), ("DELETE", 2, 2, None), ("INSERT", 3, 4, 40), ("UPDATE", 5, 3, 33), ("DELETE", 4, 3, None), ("INSERT", 6, None, 9)])
    out = apply_changes(base, ch, ["k"], "seq")
    assert sorted(rows(out.ok)) == [(1, 11), (3, 33), (4, 40)] and out.errors.count() == 1
    more = apply_changes(base, change(spark, [("INSERT", 1, 1, 5), ("INSERT", 2, 1, 6), ("INSERT", 3, 9, 7)]), ["k"], "seq", "increment")
    assert sorted(rows(more.ok)) == [(1, 21), (2, 20), (3, 30), (9, 7)]
    ignore = apply_changes(base, change(spark, [("INSERT", 1, 1, 5), ("INSERT", 2, 9, 7), ("INSERT", 3, 9, 8)]), ["k"], "seq", "insert")
    assert sorted(rows(ignore.ok)) == [(1, 10), (2, 20), (3, 30), (9, 7)]


def test_keys_from_metadata(spark):
    df = spark.createDataFrame([('{"id": 5}',), ('{"payload": {"id": 6}}',), ("x",)], "key string").withColumn(META, meta(key=F.col("key")))
    assert [r.id for r in key_from_metadata(df, "id long").collect()] == [5, 6, None]


def test_envelopes(spark):
    texts = [
        '{"payload":{"before":null,"after":{"id":1},"op":"c","source":{"db":"d","table":"t"},"ts_ms":1704067200000}}',
        '{"before":{"id":2},"after":null,"op":"d"}',
        '{"id":3}',
        '{"op":"u"}',
        "not json",
        '{"ddl":"DROP TABLE t","databaseName":"d"}',
        None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    plain = apply(df.where("value is not null and value not like '%ddl%'"), "normalize_envelope", {"schema": "id long"})
    assert [(r.id, r._meta.op) for r in plain.ok.collect()] == [(1, "INSERT"), (2, "DELETE"), (3, "INSERT")]
    assert sorted(r.message for r in plain.errors.collect()) == ["envelope: an operation without a row image", "envelope: not JSON"]
    full = apply(df, "debezium_cdc", {"schema": "id long"})
    got = [(r.id, r._meta.op, r._meta.table, r._event_time) for r in full.ok.collect()]
    assert got[:2] == [(1, "INSERT", "t", "2024-01-01T00:00:00Z"), (2, "DELETE", None, None)] and (None, "DDL", None, None) in got and len(got) == 4
    guarded = apply(full.ok, "cdc_policy", {})
    assert guarded.errors.first().error_class == "schema" and guarded.ok.count() == 3
    assert apply(full.ok, "cdc_policy", {"ddl_policy": "pass"}).ok.count() == 4
    assert apply(full.ok, "ddl_guard", {"ddl_allow": ["(?i)^drop"]}).ok.count() == 4


def test_table_names(spark):
    df = spark.createDataFrame([("shop", "orders_2024"), ("crm", "users"), ("x", "y")], "d string, t string")
    df = df.withColumn(META, meta(database=F.col("d"), table=F.col("t")))
    config = {"rules": {"shop.orders_*": "orders", "user?": "people"}, "regex": "^(.)$", "replacement": "tab_$1", "template": "{source_db}__{source_table}"}
    out = ok(df, "table_mapping", config)
    assert [(r._meta.table, r._source_table) for r in out.collect()] == [("orders", "orders_2024"), ("people", "users"), ("tab_y", "y")]


def test_ddl_in_other_dialects():
    assert translate_ddl("ALTER TABLE `a` ADD COLUMN `c` int(11) NOT NULL", "clickhouse") == "ALTER TABLE a ADD COLUMN c Int32"
    assert translate_ddl("alter table a modify c decimal(10,2)", "postgresql") == "ALTER TABLE a ALTER COLUMN c TYPE DECIMAL(10,2)"
    assert translate_ddl("alter table a change c d varchar(9)", "postgresql") == "ALTER TABLE a RENAME COLUMN c TO d; ALTER TABLE a ALTER COLUMN d TYPE VARCHAR(9)"
    assert translate_ddl("alter table a drop c", "postgresql") == "ALTER TABLE a DROP COLUMN c"
    assert translate_ddl("create table a (b int)", "clickhouse") is None


def test_router_and_tap(people):
    out = ok(people, "router", {"field": "id", "routes": {1: "one", "2": "two"}, "default": "rest"})
    assert [r._route for r in out.collect()] == ["one", "two", "rest"]
    tapped = ok(people, "tap", {"name": "seen"})
    assert tapped.count() == 3


def test_errors_have_classes():
    told = {
        "dial tcp: connection refused": "transient",
        "Error 1105 (HY000): errCode = 2, detailMessage = There is no scanNode Backend available.[10003: not alive]": "transient",
        "authentication: i/o timeout": "transient",
        "schema registry connection refused": "transient",
        "access denied for user": "auth",
        "unknown column amount": "schema",
        "no such column": "schema",
        "Error 1146 (42S02): Table 'target.orders' doesn't exist": "schema",
        "host is required": "config",
        "invalid config: x": "config",
        "duplicate key constraint failed": "data",
        "Error 1264 (22003): Out of range value for column 'soc' at row 1": "data",
        "Error 1406 (22001): Data too long for column 'vin' at row 1": "data",
        "Error 1292 (22007): Incorrect datetime value: '2024-03-09T16:00:01.123Z' for column '_event_time' at row 1": "data",
        "nil pointer": "programming",
    }
    assert {m: classify(m) for m in told} == told
    assert retryable("i/o timeout") and not retryable("Error 1264: Out of range value")
    assert [classify(x) for x in (TimeoutError(), "connection refused", "access denied", "Unknown column x", "boom", ConfigError("x"), KeyError("k"))] == ["transient", "transient", "auth", "schema", "unknown", "config", "programming"]
    assert retryable("deadlock found") and retryable("boom") and not retryable("access denied")


def test_dry_run(spark):
    got = dry_run(spark, {"id": 1, "v": "5"}, [("cast", {"fields": {"v": "to_int"}}), {"type": "filter", "expression": "v > 4"}])
    assert got == {"records": [{"id": 1, "v": 5}], "errors": [], "filtered": False}
    assert dry_run(spark, {"id": 1}, [("filter", {"expression": "id > 4"})])["filtered"]
