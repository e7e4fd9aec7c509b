"""Specifications, graphs, hooks and whole runs."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from riverloom.functions.predicates import ConfigError
from riverloom.operators.outcome import META, Context
from riverloom.plans.compile import FailedRows, compile_spec, run
from riverloom.plans.hooks import Hooks
from riverloom.plans.spec import Graph, Spec, expand, faults, parse, to_graph, topological, validate
from riverloom.streaming.control import AlertRule, Alerts, Breaker, next_run, rate_options, trigger, with_retry

YAML = """
pipeline:
  name: ${NAME:-orders}
  batch_size: 500
  source: {type: file, config: {path: "${IN}", format: csv}}
  transforms:
    - type: cast
      config: {fields: {amount: to_float}, on_error: fail}
    - type: filter
      config: {expression: "amount > 1"}
    - sort: {}
      type: sort
      config: {fields: [id]}
  sink: {type: file_sink, config: {path: "${OUT}", format: json}}
"""


def test_variables():
    assert expand("a ${X} ${Y:-d} ${Z:-} ${E:-e}", {"X": "1", "E": ""}) == "a 1 d  e"


def test_parse_and_defaults():
    spec = parse(YAML, {"IN": "i", "OUT": "o"})
    assert isinstance(spec, Spec) and spec.name == "orders" and spec.options["batch_size"] == 500 and spec.options["flush_interval_ms"] == 1000
    assert [t.type for t in spec.transforms] == ["cast", "filter", "sort"] and faults(spec) == []
    assert topological(to_graph(spec)) == ["source", "t0", "t1", "t2", "sink"]


def test_processors_come_first(spark):
    spec = parse({"name": "p", "source": "table", "processors": {"data_masking": {"fields": {"v": "mask_all"}}}, "transforms": [{"type": "field_enrichment", "config": {"pipeline": "p"}}]})
    out = compile_spec(spec, spark.createDataFrame([("x",)], "v string")).sinks["sink"].first()
    assert out.v == "********" and out._pipeline == "p"


def test_all_faults_are_told():
    bad = {"source": {"type": "fax"}, "sink": {"type": "drum"}, "batch_size": 0, "schedule": "daily", "transforms": [{"type": "nope"}, {"type": "window", "config": {"window_type": "session"}}, {"type": "filter", "config": {"keyed_state": True}}]}
    found = "; ".join(faults(parse(bad)))
    for part in ("name", "batch_size", "fax", "drum", "daily", "nope", "tumbling", "keyed state"):
        assert part in found
    assert "streaming source" in "; ".join(faults(parse({"name": "x", "source": "mysql_batch", "schedule": "streaming"})))
    with pytest.raises(ConfigError):
        validate(parse(bad))
    with pytest.raises(ConfigError):
        parse({"name": "x"})


def graph(nodes, edges):
    return parse({"name": "g", "nodes": [{"id": i, "kind": k, **more} for i, k, more in nodes], "edges": [{"from": a, "to": b, **more} for a, b, more in edges]})


def test_graph_faults():
    g = graph([("s", "source", {}), ("s", "source", {}), ("t", "transform", {"plugin": "nope"}), ("x", "cloud", {}), ("k", "sink", {})], [("s", "t", {}), ("t", "q", {}), ("k", "t", {}), ("t", "s", {})])
    found = "; ".join(faults(g))
    for part in ("twice", "nope", "cloud", "no node 'q'", "leaves a sink", "enters a source"):
        assert part in found
    loop = graph([("s", "source", {}), ("a", "merge", {}), ("b", "merge", {}), ("k", "sink", {})], [("s", "a", {}), ("a", "b", {}), ("b", "a", {}), ("b", "k", {})])
    assert topological(loop) is None and "cycle" in "; ".join(faults(loop))


def test_graph_runs_every_kind(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    dim = spark.createDataFrame([("a", 10)], "k string, v int")
    g = graph(
        [
            ("s", "source", {}),
            ("f", "fanout", {}),
            ("l", "lookup", {"config": {"table": "d", "key": "k", "fields": ["v"], "on_miss": "dlq"}}),
            ("t", "tap", {}),
            ("w", "transform", {"plugin": "flat_map", "config": {"explode": "parts"}}),
            ("c", "transform", {"plugin": "sql", "config": {"query": "select id, array('x', 'y') as parts from input"}}),
            ("k", "sink", {}),
        ],
        [("s", "f", {}), ("f", "l", {}), ("l", "t", {}), ("t", "k", {}), ("f", "c", {"condition": {"field": "id", "op": "ge", "value": 2}}), ("c", "w", {}), ("w", "k", {})],
    )
    assert isinstance(g, Graph)
    done = compile_spec(g, df, Context(tables={"d": dim}))
    got = sorted(((r.id, r.k, r.v, r.parts) for r in done.sinks["k"].collect()), key=str)
    assert got == sorted([(1, "a", 10, None), (2, None, None, "x"), (2, None, None, "y"), (3, None, None, "x"), (3, None, None, "y")], key=str)
    assert sorted((r.node, r.error_class) for r in done.errors.collect()) == [("l", "data"), ("l", "data")]


def test_a_run_reads_compiles_and_writes(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,amount,note\n2,5.5,"a,b"\n1,0.5,x\n3,much,y\n4,7,\n')
    seen = []
    spec = parse(YAML, {"IN": str(tmp_path / "in.csv"), "OUT": str(tmp_path / "out")})
    spec.hooks = {"on_init": seen.append, "on_post_batch": [seen.append], "on_shutdown": lambda e: 1 / 0}
    run(spark, spec, errors_to=str(tmp_path / "bad"))
    out = spark.read.json(str(tmp_path / "out")).orderBy("id").collect()
    assert [(r.id, r.amount) for r in out] == [("2", 5.5), ("4", 7.0)]
    (bad,) = spark.read.json(str(tmp_path / "bad")).collect()
    assert bad.message == "cast: amount is no to_float" and json.loads(bad.record)["id"] == "3"
    assert [e["event"] for e in seen] == ["on_init", "on_post_batch"]


def test_failed_rows_do_not_vanish(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,amount,note\n2,5.5,"a,b"\n3,much,y\n')
    spec = parse(YAML, {"IN": str(tmp_path / "in.csv"), "OUT": str(tmp_path / "out")})
    with pytest.raises(FailedRows, match="amount is no to_float"):
        run(spark, spec)
    assert not (tmp_path / "out").exists()
    run(spark, spec, drop_errors=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    spec.sink.type, spec.sink.config = "table", {"path": str(tmp_path / "t"), "primary_key": "note", "seq": "amount"}
    (tmp_path / "in.csv").write_text("id,amount,note\n2,5.5,x\n3,7,\n")
    with pytest.raises(FailedRows, match="without a key"):
        run(spark, spec)
    run(spark, spec, errors_to=str(tmp_path / "bad"))
    assert "without a key" in spark.read.json(str(tmp_path / "bad")).first().message


def test_shared_rows_are_computed_once(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id\n" + "\n".join(map(str, range(10))) + "\n")
    calls = spark.sparkContext.accumulator(0)

    def f(row):
        calls.add(1)
        if row["id"] == "3":
            raise ValueError("three")
        return True

    out = lambda n: {"id": n, "kind": "sink", "plugin": "file_sink", "config": {"path": str(tmp_path / n)}}
    spec = {
        "name": "g",
        "nodes": [{"id": "s", "kind": "source", "plugin": "file", "config": {"path": str(tmp_path / "in.csv")}}, {"id": "f", "kind": "transform", "plugin": "python", "config": {"function": "f"}}, out("a"), out("b")],
        "edges": [{"from": "s", "to": "f"}, {"from": "f", "to": "a"}, {"from": "f", "to": "b"}],
    }
    run(spark, spec, Context(functions={"f": f}), errors_to=str(tmp_path / "bad"))
    assert [spark.read.json(str(tmp_path / n)).count() for n in ("a", "b", "bad")] == [9, 9, 1]
    assert calls.value == 10


def test_graphs_have_hooks_and_processors(spark, tmp_path):
    seen = []
    spec = parse({
        "name": "g",
        "hooks": {"on_checkpoint": [seen.append]},
        "processors": [{"type": "filter", "config": {"expression": "id > 1"}}, {"type": "rename", "config": {"mappings": {"id": "n"}}}],
        "nodes": [{"id": "s", "kind": "source", "plugin": "demo", "config": {"count": 5, "fields": {"id": "counter"}}}, {"id": "o", "kind": "sink", "plugin": "file_sink", "config": {"path": str(tmp_path / "o")}}],
        "edges": [{"from": "s", "to": "o"}],
    })
    run(spark, spec)
    assert sorted(r.n for r in spark.read.json(str(tmp_path / "o")).collect()) == [2, 3, 4]
    assert [e["event"] for e in seen] == ["on_checkpoint"]


def test_hooks_are_checked():
    with pytest.raises(ConfigError):
        Hooks.of({"on_lunch": print}, {})
    with pytest.raises(ConfigError):
        Hooks.of({"on_init": "absent"}, {})


def test_plans_stay_in_the_jvm(spark):
    """Built-in operators run no Python, and filters and columns reach the scan."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    spec = {"name": "p", "source": "table", "transforms": [{"type": "filter", "config": {"expression": "o_orderstatus == 'F' and o_totalprice > 1000"}}, {"type": "project", "config": {"mappings": {"o_orderkey": "id"}}}]}
    plan = compile_spec(spec, orders).sinks["sink"]._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "EqualTo" in plan or "o_orderstatus" in plan
    assert "o_custkey" not in plan and "o_orderdate" not in plan.split("ReadSchema")[-1]


def test_retry_breaker_and_schedules():
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("connection refused")
        return "done"

    assert with_retry(flaky, pause=pauses.append, seed=1) == "done" and len(pauses) == 2 and 1 <= pauses[0] <= 1.25 and 2 <= pauses[1] <= 2.5
    with pytest.raises(KeyError):
        with_retry(lambda: {}["x"], pause=pauses.append)
    assert len(pauses) == 2

    now = [0.0]
    b = Breaker(failures=2, window=10, rest=5, clock=lambda: now[0])
    b.failure()
    now[0] = 20
    b.failure()
    assert b.state == "closed"
    b.failure()
    assert b.state == "open" and not b.allow()
    now[0] = 26
    assert b.allow() and b.state == "half-open" and not b.allow()
    b.failure()
    assert b.state == "open"
    now[0] = 32
    assert b.allow()
    b.success()
    assert b.state == "closed"

    t = datetime.datetime(2024, 2, 28, 23, 59, 30)
    assert next_run({"type": "cron", "cron": "*/15 0 * * *"}, t) == datetime.datetime(2024, 2, 29, 0, 0)
    assert next_run({"type": "cron", "cron": "30 9 * * 1-5"}, t) == datetime.datetime(2024, 2, 29, 9, 30)
    assert next_run({"type": "periodic", "interval_sec": 90}, t) == datetime.datetime(2024, 2, 29, 0, 1)
    assert next_run({"type": "once"}, t) is None
    assert trigger({"schedule": "streaming", "flush_interval_ms": 200}) == {"processingTime": "200 milliseconds"} and trigger({}) == {"availableNow": True}
    assert next_run({"type": "cron", "cron": "0 0 29 2 *"}, datetime.datetime(2025, 1, 1)) == datetime.datetime(2028, 2, 29)
    assert next_run({"type": "cron", "cron": "0 0 29 2 1"}, datetime.datetime(2025, 1, 1)) == datetime.datetime(2044, 2, 29)
    assert next_run({"type": "cron", "cron": "0 0 31 2 *"}, datetime.datetime(2025, 1, 1)) is None
    assert rate_options({"rps": 50}, "kafka") == {"maxOffsetsPerTrigger": "50"}


def test_alert_rules():
    class Progress:
        numInputRows = 10
        eventTime = {"max": "2024-01-01T00:00:00.000Z"}
        observedMetrics = {}

    told = []
    start = datetime.datetime(2024, 1, 1, 0, 2, tzinfo=datetime.timezone.utc).timestamp()
    alerts = Alerts([AlertRule("lag", "lag_seconds", 60), AlertRule("quiet", "rows", 1, below=True)], lambda n, m: told.append((n, m["lag_seconds"])), clock=lambda: start)

    class Event:
        progress = Progress

    alerts.onQueryProgress(Event)
    assert told == [("lag", 120.0)]


def test_meta_reaches_edges(spark):
    from riverloom.operators.cdc import with_meta

    df = with_meta(spark.createDataFrame([(1,), (2,)], "id int"), F.when(F.col("id") == 1, "DELETE").otherwise("INSERT"))
    g = graph([("s", "source", {}), ("a", "sink", {}), ("b", "sink", {})], [("s", "a", {"condition": {"field": "_meta.op", "op": "eq", "value": "DELETE"}}), ("s", "b", {})])
    done = compile_spec(g, df)
    assert done.sinks["a"].count() == 1 and done.sinks["b"].count() == 2 and META in done.sinks["a"].columns
