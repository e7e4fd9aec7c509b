"""Streams to the end of what is there, held against the batch result."""

from __future__ import annotations

import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from riverloom.functions.predicates import ConfigError
from riverloom.operators.outcome import Context, apply
from riverloom.plans.compile import run
from riverloom.sources.sinks import current_version
from riverloom.streaming.runner import PROVIDER, ROCKSDB, file_stream, isolate, run_stream

sys.path.insert(0, os.path.dirname(__file__))
SCHEMA = "id int, key string, t timestamp, v int"


@pytest.fixture()
def folder(spark, tmp_path):
    """Three files that arrive one after another, each row later than those before."""
    for n in range(3):
        rows = [(n * 10 + i, "ab"[i % 2], f"2024-01-01 00:{n * 10 + i:02d}:00", i) for i in range(10)]
        df = spark.createDataFrame(rows, "id int, key string, t string, v int").withColumn("t", F.to_timestamp("t")).coalesce(1)
        df.write.mode("append").json(str(tmp_path / "in"))
    return tmp_path


def stream(spark, folder, **options):
    return file_stream(spark, str(folder / "in"), SCHEMA, "json", **options)


def batch(spark, folder):
    return spark.read.schema(SCHEMA).json(str(folder / "in"))


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_rows_and_errors_of_a_stream(spark, folder):
    steps = [("filter", {"expression": "v > 1"}), ("validate", {"rules": [{"field": "v", "type": "range", "max": 7}]}), ("project", {"fields": ["id"]})]
    seen = []
    sink = ("file_sink", {"path": str(folder / "out"), "format": "json"})
    finish(run_stream(stream(spark, folder, maxFilesPerTrigger=1), steps, sink, str(folder / "cp"), errors_to=str(folder / "bad"), on_batch=seen.append))
    assert spark.read.json(str(folder / "out")).count() == 18 and spark.read.json(str(folder / "bad")).count() == 6
    assert seen == [0, 1, 2]
    finish(run_stream(stream(spark, folder), steps, sink, str(folder / "cp"), errors_to=str(folder / "bad")))
    assert spark.read.json(str(folder / "out")).count() == 18  # nothing twice


def test_window_of_a_stream(spark, folder):
    config = {"window_size_seconds": 300, "group_by": ["key"], "aggregates": [{"func": "sum", "field": "v", "alias": "s"}], "event_time": "t"}
    steps = [("window", config), ("filter", {"expression": "s > 0"})]
    finish(run_stream(stream(spark, folder, maxFilesPerTrigger=1), steps, ("file_sink", {"path": str(folder / "out"), "format": "parquet"}), str(folder / "cp")))
    got = {tuple(r) for r in spark.read.parquet(str(folder / "out")).select("window_start", "key", "s").collect()}
    want = {tuple(r) for r in apply(batch(spark, folder), "window", config).ok.where("s > 0").select("window_start", "key", "s").collect()}
    last = max(w[0] for w in want)
    assert got == {w for w in want if w[0] < last}  # the last window stays open


def test_deduplication_of_a_stream(spark, folder):
    steps = [("deduplicate", {"keys": ["key", "v"], "state_ttl_seconds": 3600})]
    context = Context(event_time="t")
    finish(run_stream(stream(spark, folder, maxFilesPerTrigger=1), steps, ("file_sink", {"path": str(folder / "out")}), str(folder / "cp"), context=context))
    assert spark.read.json(str(folder / "out")).count() == 10


def test_asof_join_of_a_stream(spark, folder):
    config = {"join_key": "key", "join_fields": ["id"], "join_window_sec": 150, "event_time": "t", "seq": "id", "join_type": "left", "where": "v != 4"}
    query = run_stream(stream(spark, folder, maxFilesPerTrigger=1), [("join", config)], ("file_sink", {"path": str(folder / "out"), "format": "parquet"}), str(folder / "cp"))
    assert spark.conf.get(PROVIDER) == ROCKSDB
    finish(query)
    out = spark.read.parquet(str(folder / "out"))
    assert dict(out.dtypes)["joined_id"] == "int"
    got = {(r.id, r.joined_id) for r in out.collect()}
    want = {(r.id, r.joined_id) for r in apply(batch(spark, folder), "join", config).ok.collect()}
    assert got == want


def test_misses_of_a_stream_are_kept(spark, folder):
    config = {"join_key": "key", "join_fields": ["id"], "join_window_sec": 150, "event_time": "t", "seq": "id", "where": "v != 4", "on_miss": "dlq"}
    with pytest.raises(ConfigError):
        run_stream(stream(spark, folder), [("join", config)], ("file_sink", {"path": str(folder / "out")}), str(folder / "cp0"))
    finish(run_stream(stream(spark, folder, maxFilesPerTrigger=1), [("join", config)], ("file_sink", {"path": str(folder / "out")}), str(folder / "cp"), errors_to=str(folder / "bad")))
    for q in spark.streams.active:
        q.awaitTermination(120)
    want = apply(batch(spark, folder), "join", config)
    assert spark.read.json(str(folder / "out")).count() == want.ok.count()
    assert sorted(json.loads(r.record)["id"] for r in spark.read.json(str(folder / "bad" / "stream")).collect()) == sorted(json.loads(r.record)["id"] for r in want.errors.collect())


def test_failed_rows_stop_a_stream_without_a_place(spark, folder):
    steps = [("validate", {"rules": [{"field": "v", "type": "range", "max": 7}]})]
    query = run_stream(stream(spark, folder), steps, ("file_sink", {"path": str(folder / "out")}), str(folder / "cp"))
    with pytest.raises(Exception, match="errors_to"):
        query.awaitTermination(120)


def test_a_batch_is_added_once(spark, folder):
    """The same files again under a new checkpoint are the same batch numbers: a table has them already."""
    sink = ("table", {"path": str(folder / "t"), "primary_key": "key", "mode": "increment", "seq": "id"})
    for n in range(2):
        finish(run_stream(stream(spark, folder), [("project", {"fields": ["key", "v", "id"]})], sink, str(folder / f"cp{n}")))
    now, version = current_version(spark, str(folder / "t"))
    assert version == 1 and sorted((r.key, r.v) for r in now.collect()) == [("a", 60), ("b", 75)]


def test_a_refused_row_stands_alone(spark, folder):
    from fake_clients import BULK

    def refuse(rows):
        if rows.where("id = 13").count():
            raise ValueError("duplicate key constraint failed")
        BULK.append(sorted(r.id for r in rows.collect()))

    BULK.clear()
    bad = isolate(batch(spark, folder), refuse, "sink").collect()
    assert [json.loads(r.record)["id"] for r in bad] == [13] and sorted(x for part in BULK for x in part) == [i for i in range(30) if i != 13]


def test_a_specification_starts_a_stream(spark, folder):
    seen, told = [], []
    spec = {
        "name": "live",
        "schedule": "streaming",
        "flush_interval_ms": 100,
        "checkpoint": str(folder / "cp"),
        "event_time": "t",
        "hooks": {"on_post_batch": [seen.append], "on_checkpoint": [seen.append]},
        "alerts": [{"name": "busy", "measure": "rows", "threshold": 1}],
        "source": {"type": "file", "config": {"path": str(folder / "in"), "format": "json", "schema": SCHEMA}},
        "transforms": [{"type": "rate_limiter", "config": {"rps": 1000}}, {"type": "filter", "config": {"expression": "v > 1"}}],
        "sink": {"type": "file_sink", "config": {"path": str(folder / "out")}},
    }
    done = run(spark, spec, tell=lambda name, found: told.append(name))
    try:
        done.query.processAllAvailable()
    finally:
        done.query.stop()
    assert spark.read.json(str(folder / "out")).count() == 24
    assert [e["event"] for e in seen][:2] == ["on_post_batch", "on_checkpoint"] and len(seen) >= 6  # a file a batch
    with pytest.raises(ConfigError):
        run(spark, {**spec, "checkpoint": None})


def test_one_stateful_operator(spark, folder):
    steps = [("deduplicate", {"keys": ["key"]}), ("window", {})]
    with pytest.raises(ConfigError):
        run_stream(stream(spark, folder), steps, ("memory", {}), str(folder / "cp"), context=Context())
