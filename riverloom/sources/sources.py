"""Batch and streaming sources by name; unreadable records go to the error output."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverloom.functions import values as V
from riverloom.functions.predicates import ConfigError
from riverloom.operators.cdc import META_TYPE, change_order, meta
from riverloom.operators.code import installed
from riverloom.operators.outcome import META, Context, Outcome, failed, need
from riverloom.operators.project import col, fnv32

SOURCES: dict[str, Callable[[SparkSession, dict, Context], Outcome]] = {}


def source(*names: str):
    def add(f):
        for n in names:
            SOURCES[n] = f
        return f

    return add


def read(spark: SparkSession, name: str, config: dict | None = None, context: Context | None = None) -> Outcome:
    """The rows of a source, its shard of them, and its unreadable records."""
    if name not in SOURCES and not (name.startswith("plugin_") and installed(name.removeprefix("plugin_"), "source")):
        raise ConfigError(f"no source {name!r}")
    config = dict(config or {})
    out = SOURCES[name](spark, config, context or Context(node=name))
    out = out if isinstance(out, Outcome) else Outcome(out)
    if config.get("shard"):
        out.ok = shard(out.ok, config["shard"])
    return out


def shard(df: DataFrame, config: dict) -> DataFrame:
    """The rows of one shard: by row number (``line_modulo``), by a hash of a key (``hash_modulo``), or all.

    The hash is FNV-1a of the key's text form. Spark deals work out by itself; this is for the reader that wants the
    same rows as one of several runs elsewhere.
    """
    total, index = int(config.get("total", 1)), int(config.get("index", 0))
    strategy = config.get("strategy", "noop")
    if total <= 1 or strategy == "noop":
        return df
    if strategy == "hash_modulo":
        name = need(config, "key", "shard")
        shown = F.col(f"{META}.key") if name == "@key" else V.key_text(col(name), V.dtype(df, name))
        return df.where(F.pmod(fnv32(F.coalesce(shown, F.lit(""))), F.lit(total)) == index)
    if strategy == "line_modulo":
        seq = need(config, "seq", "shard")
        return df.where(F.pmod(col(seq), F.lit(total)) == index)
    raise ConfigError(f"shard: no strategy {strategy!r}")


def table_name(path: str) -> str:
    return PurePosixPath(path).name.split(".")[0]


@source("file")
def file(spark: SparkSession, config: dict, context: Context) -> Outcome:
    """CSV with all columns as text, or JSON lines; Parquet and ORC as they are."""
    path = need(config, "path", "file")
    kind = config.get("format") or PurePosixPath(path).suffix.lstrip(".") or "csv"
    if config.get("streaming"):
        kind = "json" if kind in ("jsonl", "ndjson") else kind
        reader = spark.readStream.schema(need(config, "schema", "file")).options(**(config.get("reader_options") or {}))
        return Outcome((reader.option("header", config.get("has_header", True)) if kind == "csv" else reader).format(kind).load(path))
    if kind in ("parquet", "orc"):
        return Outcome(spark.read.format(kind).load(path))
    if kind == "csv":
        return Outcome(csv(spark, path, config))
    if kind in ("json", "jsonl", "ndjson"):
        return json_lines(spark, path, config, context)
    raise ConfigError(f"file: no format {kind!r}")


def csv(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """Header names or col_0, col_1, ...; every value is text, an absent one null."""
    reader = spark.read.option("sep", config.get("delimiter", ",")).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    header = config.get("has_header", config.get("header", True))
    if config.get("columns"):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in config["columns"]])
        return reader.schema(schema).option("header", header).option("enforceSchema", True).csv(path)
    df = reader.option("header", header).option("inferSchema", False).csv(path)
    return df if header else df.toDF(*[f"col_{i}" for i in range(len(df.columns))])


def json_lines(spark: SparkSession, path: str, config: dict, context: Context) -> Outcome:
    """A JSON object per line; other lines fail. Without a schema Spark's reader infers one, with numbers as doubles."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    schema = config.get("schema")
    if schema is None:
        fields = [f for f in spark.read.json(path).schema.fields if f.name != "_corrupt_record"]
        schema = T.StructType([T.StructField(f.name, T.DoubleType() if isinstance(f.dataType, T.LongType) else f.dataType) for f in fields])
    return parse_json(lines, "value", schema, context)


def parse_json(df: DataFrame, name: str, schema: str | T.StructType, context: Context, rest: list[str] | None = None) -> Outcome:
    """The fields of a JSON text column in place of it; texts that are no objects fail."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = rest or []
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = df.withColumn("__j", F.from_json(col(name), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("__j").isNull() | F.col("__j._corrupt_record").isNotNull() | ~F.trim(col(name)).startswith("{")
    keep = [col(c) for c in names if c not in schema.names]
    ok = parsed.where(~bad).select(*keep, *[F.col(f"__j.`{n}`").alias(n) for n in schema.names])
    wrong = failed(parsed.where(bad).select(*[col(c) for c in df.columns]), context.node or "source", "data", "not a JSON object")
    return Outcome(ok, wrong)


@source("table")
def table(spark: SparkSession, config: dict, context: Context) -> DataFrame:
    name = need(config, "table", "table")
    return context.tables[name] if name in context.tables else spark.read.table(name)


@source("demo")
def demo(spark: SparkSession, config: dict, context: Context) -> DataFrame:
    """Rows made from a counter: counter, random (counter * 7 modulo 100), now, static:value."""
    fields = config.get("fields") or {"id": "counter"}
    if isinstance(fields, list):
        fields = {f["name"]: f.get("type", "counter") for f in fields}
    if config.get("streaming"):
        rate = max(1, int(1000 / max(1, int(config.get("interval_ms", 1000)))))
        base = spark.readStream.format("rate").options(**{"rowsPerSecond": str(rate), **(config.get("reader_options") or {})}).load().withColumnRenamed("value", "id")
    else:
        base = spark.range(int(config.get("count", 100)))
    i = F.col("id")
    kinds: dict[str, Column] = {"counter": i, "random": F.pmod(i * 7, F.lit(100)), "now": V.rfc3339(context.time_now())}
    made = [kinds.get(kind, F.lit(kind.removeprefix("static:"))).alias(name) for name, kind in fields.items()]
    return base.select(*made, meta(op=F.lit("INSERT"), source=F.lit("demo"), seq=i + 1, ts=context.time_now()).alias(META))


@source("jdbc", "mysql_batch")
def jdbc(spark: SparkSession, config: dict, context: Context) -> DataFrame:
    """A table or query in key ranges that are read side by side, beyond a watermark where one is given."""
    return jdbc_reader(spark, config).load()


def jdbc_options(config: dict) -> dict[str, str]:
    """Reader options: the query, columns, watermark and key ranges of a configuration."""
    key = config.get("cursor_column") or config.get("primary_key") or config.get("pk")
    name = config.get("table")
    inner = f"({config['query']}) q" if config.get("query") else need({"table": name}, "table", "jdbc")
    columns = ", ".join(config.get("columns") or ["*"])
    cursor = config.get("cursor")
    where = []
    if cursor is not None:
        where.append(f"{need({'pk': key}, 'pk', 'jdbc')} > {cursor!r}" if isinstance(cursor, str) else f"{need({'pk': key}, 'pk', 'jdbc')} > {cursor}")
    if config.get("shard_total"):
        where.append(f"MOD({need({'pk': key}, 'pk', 'jdbc')}, {int(config['shard_total'])}) = {int(config.get('shard_index', 0))}")
    text = f"select {columns} from {inner}" + (" where " + " and ".join(where) if where else "")
    out = {"url": need(config, "url", "jdbc"), "dbtable": f"({text}) t", "fetchsize": str(config.get("page_size", 10_000))}
    for a in ("user", "password", "driver"):
        if config.get(a):
            out[a] = str(config[a])
    if key and config.get("lower") is not None and config.get("upper") is not None:
        out |= {"partitionColumn": key, "lowerBound": str(config["lower"]), "upperBound": str(config["upper"]), "numPartitions": str(config.get("partitions", 8))}
    return out


def jdbc_reader(spark: SparkSession, config: dict):
    return spark.read.format("jdbc").options(**jdbc_options(config))


@source("mysql_cdc", "postgres_cdc", "mysql_snapshot_cdc")
def cdc_files(spark: SparkSession, config: dict, context: Context) -> Outcome:
    """Change rows that a capture tool wrote as JSON lines of Debezium envelopes, with an optional snapshot before them.

    Reading a database's log needs a client of that database outside Spark; what it delivers is read here. The order of
    the changes is that of the log (``cdc.change_order``). A snapshot's rows are inserts with order 0, so later changes
    win. TRUNCATE events fail unless ``truncate`` is ``skip``.
    """
    return change_rows(spark.read.text(need(config, "changes", "cdc")), config, context)


def change_rows(lines: DataFrame, config: dict, context: Context) -> Outcome:
    """What ``cdc_files`` reads, from lines (value)."""
    from riverloom.operators.outcome import apply, union_errors

    lines = lines.select("value").withColumn("__seq", change_order(F.col("value")))
    letter = F.coalesce(F.get_json_object("value", "$.payload.op"), F.get_json_object("value", "$.op"))
    truncates = F.coalesce(letter == "t", F.lit(False))
    errors = None
    if config.get("truncate", "error") != "skip":
        errors = failed(lines.where(truncates).select("value"), context.node or "source", "data", "TRUNCATE is not supported")
    done = apply(lines.where(~truncates), "debezium_cdc", {"column": "value", "schema": need(config, "schema", "cdc"), "seq": "__seq", "keep_metadata": False})
    rows = done.ok
    if config.get("snapshot"):
        first = lines.sparkSession.read.format(config.get("snapshot_format", "parquet")).load(config["snapshot"])
        image = T._parse_datatype_string(config["schema"])
        first = first.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in image.fields])
        first = first.withColumn(META, meta(op=F.lit("INSERT"), table=F.lit(config.get("table")), seq=F.lit(0)))
        rows = first.unionByName(rows, allowMissingColumns=True)
    return Outcome(rows, union_errors([errors, done.errors]))


@source("kafka")
def kafka(spark: SparkSession, config: dict, context: Context) -> Outcome:
    """Messages of a topic, decoded; see ``decode_messages``. Needs Spark's Kafka connector on the class path."""
    reader = spark.readStream if config.get("streaming") else spark.read
    options = {"kafka.bootstrap.servers": ",".join(need(config, "brokers", "kafka")), "subscribe": need(config, "topic", "kafka"), "startingOffsets": config.get("offset", "earliest")}
    options |= config.get("reader_options") or {} if config.get("streaming") else {}
    if config.get("max_offsets_per_trigger"):
        options["maxOffsetsPerTrigger"] = str(config["max_offsets_per_trigger"])
    return decode_messages(reader.format("kafka").options(**options).load(), config, context)


def decode_messages(messages: DataFrame, config: dict, context: Context | None = None) -> Outcome:
    """Rows from messages (key, value, topic, partition, offset, timestamp).

    Formats: ``json`` (an object's fields), ``envelope`` (Debezium-like, or {op, table, key, data}), ``canal_json``
    ({type, database, table, data[]}: a row per element), ``raw``; ``value_column`` keeps the text under a name. A null
    value is a delete (``tombstone_policy`` skip drops it). What does not parse stays as ``value`` (``raw``), is dropped
    (``skip``) or fails (``dlq``). ``expand_key_json`` lists fields of a JSON key that become ``__key_<name>``.
    """
    context = context or Context(node="kafka")
    kind = config.get("format", "json")
    if kind not in ("json", "envelope", "canal_json", "raw"):
        raise ConfigError(f"kafka: no format {kind!r}")
    policy = config.get("on_parse_error", "raw")
    if policy not in ("raw", "skip", "dlq"):
        raise ConfigError(f"kafka: on_parse_error {policy!r}")
    df = messages.withColumn("__v", F.col("value").cast("string")).withColumn("__k", F.col("key").cast("string"))
    tomb = F.col("__v").isNull()
    if config.get("tombstone_policy", "delete") == "skip":
        df = df.where(~tomb)
    base = {"source": F.lit("kafka"), "key": F.col("__k"), "ts": F.col("timestamp").cast("timestamp"), "seq": F.col("offset")}
    op: Column = F.when(tomb, "DELETE").otherwise("INSERT")
    table_: Column = F.col("topic")
    database: Column = F.lit(None)
    image = config.get("schema")
    image = T._parse_datatype_string(image) if isinstance(image, str) else image
    fields: list[Column] = []
    good: Column = F.lit(True)
    if config.get("value_column"):
        fields = [F.col("__v").alias(config["value_column"])]
    elif kind == "raw":
        fields = [F.col("__v").alias("value")]
    else:
        if image is None:
            raise ConfigError("kafka: the schema of the rows is required")
        corrupt = T.StructField("_corrupt_record", T.StringType())
        options = {"columnNameOfCorruptRecord": "_corrupt_record"}
        if kind == "json":
            df = df.withColumn("__j", F.from_json("__v", T.StructType([*image.fields, corrupt]), options))
            row: Column = F.col("__j")
            good = F.col("__j").isNotNull() & F.col("__j._corrupt_record").isNull() & F.trim("__v").startswith("{")
        elif kind == "canal_json":
            shape = T.StructType([T.StructField("type", T.StringType()), T.StructField("database", T.StringType()), T.StructField("table", T.StringType()), T.StructField("data", T.ArrayType(image)), corrupt])
            df = df.withColumn("__j", F.from_json("__v", shape, options))
            good = F.col("__j").isNotNull() & F.col("__j.data").isNotNull()
            df = df.withColumn("__row", F.explode_outer("__j.data"))
            row = F.col("__row")
            op = F.when(tomb, "DELETE").otherwise(F.coalesce(F.upper("__j.type"), F.lit("INSERT")))
            table_, database = F.coalesce("__j.table", "topic"), F.col("__j.database")
        else:
            inner = T.StructType([T.StructField("before", image), T.StructField("after", image), T.StructField("op", T.StringType()), T.StructField("source", T.StructType([T.StructField("db", T.StringType()), T.StructField("table", T.StringType())])), T.StructField("ts_ms", T.LongType())])
            outer = T.StructType([*inner.fields, T.StructField("payload", inner), T.StructField("data", image), T.StructField("table", T.StringType()), T.StructField("key", T.StringType()), corrupt])
            df = df.withColumn("__j", F.from_json("__v", outer, options))
            p = F.coalesce(F.col("__j.payload"), F.struct(*[F.col(f"__j.{f.name}").alias(f.name) for f in inner.fields]))
            df = df.withColumn("__p", p)
            legacy = F.col("__j.data").isNotNull()
            letter = F.col("__p.op")
            row = F.when(legacy, F.col("__j.data")).when(letter == "d", F.col("__p.before")).otherwise(F.coalesce("__p.after", "__p.before"))
            good = F.col("__j").isNotNull() & row.isNotNull()
            named = F.when(letter.isin("c", "r"), "INSERT").when(letter == "u", "UPDATE").when(letter == "d", "DELETE")
            op = F.when(tomb, "DELETE").when(legacy, F.when(letter.isin("UPDATE", "DELETE"), letter).otherwise("INSERT")).otherwise(F.coalesce(named, F.lit("UPDATE")))
            table_, database = F.coalesce("__p.source.table", "__j.table", "topic"), F.col("__p.source.db")
            base["ts"] = F.coalesce(F.timestamp_millis("__p.ts_ms"), F.col("timestamp").cast("timestamp"))
            base["key"] = F.coalesce("__j.key", "__k")
        fields = [row.getField(n).alias(n) for n in image.names]
        if policy == "raw":
            fields.append(F.when(~(good | tomb), F.col("__v")).alias("value"))
    if config.get("key_column"):
        fields.append(F.col("__k").alias(config["key_column"]))
    for name in config.get("expand_key_json") or []:
        fields.append(F.coalesce(F.get_json_object("__k", f"$.payload.{name}"), F.get_json_object("__k", f"$.{name}")).alias(f"__key_{name}"))
    fields.append(tomb.alias("__tombstone"))
    df = df.withColumn(META, meta(op=op, table=table_, database=database, **base))
    fine = tomb | F.coalesce(good, F.lit(False))
    if policy == "raw" or config.get("value_column") or kind == "raw":
        return Outcome(df.select(*fields, META))
    ok = df.where(fine).select(*fields, META)
    if policy == "skip":
        return Outcome(ok)
    bad = df.where(~fine).select("topic", "partition", "offset", F.col("__v").alias("value"))
    return Outcome(ok, failed(bad, context.node, "data", f"kafka: not {kind}"))


def python_source(spark: SparkSession, name: str, options: dict[str, Any], schema: str) -> DataFrame:
    from riverloom.sources.remote import register

    register(spark)
    return spark.read.format(f"riverloom_{name}").options(**{k: v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}).schema(schema).load()


def _remote(kind: str, *names: str) -> None:
    @source(*names)
    def remote(spark: SparkSession, config: dict, context: Context) -> DataFrame:
        return python_source(spark, kind, config, need(config, "schema", names[0]))


_remote("rest", "http", "rest_source")
_remote("redis", "redis")
_remote("sheet", "feishu_sheet")


def _preset(name: str):
    @source(name)
    def preset(spark: SparkSession, config: dict, context: Context) -> DataFrame:
        from riverloom.sources.remote import preset_options

        return python_source(spark, "rest", preset_options(name, config), need(config, "schema", name))

    return preset


for _name in ("salesforce", "github", "hubspot", "stripe", "notion"):
    _preset(_name)

__all__ = ["META_TYPE", "decode_messages", "read", "shard"]
