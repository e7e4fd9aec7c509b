"""Sinks by name: files, tables with merge semantics, stores, and messages."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverloom.functions import values as V
from riverloom.functions.predicates import ConfigError
from riverloom.operators import cdc
from riverloom.operators.code import installed
from riverloom.operators.joins import names_of
from riverloom.operators.outcome import BEFORE, META, need
from riverloom.operators.project import col
from riverloom.operators.rows import payload
from riverloom.sources import stores, typing

#: A sink writes rows and returns those that failed, if any can.
SINKS: dict[str, Callable[[DataFrame, dict], DataFrame | None]] = {}
MEMORY: dict[str, list] = {}


def sink(*names: str):
    def add(f):
        for n in names:
            SINKS[n] = f
        return f

    return add


def write(df: DataFrame, name: str, config: dict | None = None) -> DataFrame | None:
    """Writes rows to a sink; returns the rows that it could not take (schema ERROR_SCHEMA), if any can fail."""
    if name not in SINKS and not (name.startswith("plugin_") and installed(name.removeprefix("plugin_"), "sink")):
        raise ConfigError(f"no sink {name!r}")
    return SINKS[name](df, dict(config or {}))


def write_observed(df: DataFrame, name: str, config: dict | None = None, by_table: bool = False) -> dict:
    """``write``, and what it wrote: rows by operation, counted on the way, rows that failed, and seconds.

    ``by_table`` adds rows and operations of each table of the change data, which reads the rows once more.
    """
    from time import perf_counter

    from pyspark.sql import Observation

    if META not in df.columns:
        df = df.withColumn(META, cdc.meta(op=F.lit("INSERT")))
    op, table_ = F.col(f"{META}.op"), F.coalesce(F.col(f"{META}.table"), F.lit(""))
    seen = Observation()
    counts = [F.count_if(op == k).alias(k.lower()) for k in ("INSERT", "UPDATE", "DELETE", "DDL")]
    seen_rows = df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts, F.approx_count_distinct(table_).alias("tables"))
    start = perf_counter()
    errors = write(seen_rows, name, config)
    out = {**seen.get, "seconds": perf_counter() - start, "failed": 0 if errors is None else errors.count()}
    if by_table:
        found = df.groupBy(table_.alias("t")).agg(F.count(F.lit(1)).alias("rows"), *counts)
        out["by_table"] = {r["t"]: {k: r[k] for k in ("rows", "insert", "update", "delete", "ddl")} for r in found.collect()}
    return out


def live_rows(df: DataFrame) -> DataFrame:
    """Payload columns of rows that are not deletes or DDL."""
    if META in df.columns:
        df = df.where(~F.coalesce(F.col(f"{META}.op"), F.lit("INSERT")).isin("DELETE", "DDL"))
    return df.select(*[col(c) for c in payload(df)])


@sink("file_sink", "s3")
def files(df: DataFrame, config: dict) -> None:
    """JSON lines, CSV or Parquet; deletes are left out. Spark's committer publishes a whole write or nothing."""
    kind = {"jsonl": "json"}.get(config.get("format", "json"), config.get("format", "json"))
    if kind not in ("json", "csv", "parquet", "orc"):
        raise ConfigError(f"file_sink: no format {kind!r}")
    rows = live_rows(df)
    if kind == "parquet":
        rows = rows.select(*[col(c) for c in sorted(rows.columns)])
    path = need(config, "path", "file_sink")
    if config.get("date_prefix"):
        path = f"{path.rstrip('/')}/{config['date_prefix']}"
    writer = rows.write.mode(config.get("mode", "append")).format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    if config.get("partition_by"):
        writer = writer.partitionBy(*config["partition_by"])
    writer.save(path)


@sink("memory")
def memory(df: DataFrame, config: dict) -> None:
    """For tests and dry runs: rows come to the driver. More than ``limit`` rows (1,000 by default) are an error."""
    most = int(config.get("limit", 1000))
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ConfigError(f"memory: more than {most} rows")
    MEMORY[config.get("name", "memory")] = rows


def pre_write(base: DataFrame | None, config: dict | None, processing: date | None = None, params: dict | None = None) -> DataFrame | None:
    """What stays of a target before it is written: ``delete`` by condition, ``truncate``, ``truncate_partition``.

    ${PROCESSING_DATE} and ${params.name} stand in conditions and partition values.
    """
    if not config or base is None:
        return base
    fill = lambda s: re.sub(r"\$\{params\.(\w+)\}", lambda m: str((params or {})[m.group(1)]), s.replace("${PROCESSING_DATE}", (processing or date.today()).isoformat()))
    action = config.get("action", config.get("type"))
    if action == "truncate":
        return base.limit(0)
    if action == "delete":
        gone = F.expr(fill(need(config, "condition", "pre_write")))
        return base.where(~F.coalesce(gone, F.lit(False)))
    if action == "truncate_partition":
        gone = F.lit(True)
        for k, v in need(config, "partition", "pre_write").items():
            gone = gone & (col(k).cast("string") == fill(str(v)))
        return base.where(~F.coalesce(gone, F.lit(False)))
    raise ConfigError(f"pre_write: no action {action!r}")


def merged(base: DataFrame, df: DataFrame, config: dict):
    """Base with changes applied: insert, upsert or increment by primary key, the last change first compacted."""
    keys = need(config, "primary_key", "table")
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = config.get("seq") or "__seq"
    if order not in df.columns:
        if META not in df.columns:
            raise ConfigError("table: an order column (seq) or change data is required")
        df = df.withColumn(order, F.col(f"{META}.seq"))
    mode = config.get("mode", "upsert")
    if mode not in ("insert", "upsert", "increment"):
        raise ConfigError(f"table: mode {mode!r}")
    return cdc.apply_changes(base, df, keys, order, mode)


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _hadoop(spark, path)
    return fs.exists(where)


@sink("table")
def table(df: DataFrame, config: dict) -> DataFrame | None:
    """A table of versioned Parquet folders under ``path`` with merge semantics.

    insert, upsert and increment read the current version, join the changes, and write the next one; ``versions``
    appends change rows with their order instead and is read through ``final_view``. ``partition_overwrite`` replaces
    the partitions that the rows name. A version is written aside and takes its number at the end; where another writer
    took it first, the write fails and can be tried again. With ``batch``, the number of a stream's batch, a version
    names its batch, and a batch that has its version is not written again. Changes without a key are returned.

    ``buckets`` deals a new table's rows to so many folders by a hash of the key; a write then reads and replaces only
    those that its changes fall into, and a version is a list of folders. ``vacuum`` deletes what old versions hold.
    """
    spark = df.sparkSession
    path, mode = need(config, "path", "table").rstrip("/"), config.get("mode", "upsert")
    if mode == "partition_overwrite":
        overwrite_partitions(df, config)
        return None
    if mode in ("append", "versions"):
        rows = df if mode == "versions" else live_rows(df)
        rows.write.mode("append").option("mergeSchema", True).parquet(path)
        return None
    current, number = current_version(spark, path)
    batch = config.get("batch")
    known = manifest(spark, path, number)
    buckets = known["buckets"] if known else int(config.get("buckets", 1)) if number == 0 else 1
    touched: list[int] = []
    if buckets > 1:
        touched = list(range(buckets)) if config.get("pre_write") else changed_buckets(df, config, buckets)
        folders = [f"{path}/{known['folders'][str(k)]}" for k in touched if str(k) in known["folders"]] if known else []
        current = spark.read.option("mergeSchema", True).parquet(*folders) if folders else None if current is None else current.limit(0)
    rows = live_rows(df).limit(0) if current is None else current
    rows, df = typing.evolve(rows, df, config.get("schema_drift", "ignore"))
    rows = pre_write(rows, config.get("pre_write"), params=config.get("params"))
    done = merged(rows, df, config)
    if batch is not None and exists(spark, f"{path}/v={number}/_BATCH_{batch}"):
        return done.errors
    aside = f"{path}/.{uuid.uuid4().hex}"
    if buckets > 1:
        data = f"data/{uuid.uuid4().hex}"
        part = bucket_of(done.ok, names_of(config["primary_key"]), buckets)
        done.ok.withColumn(BUCKET, part).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{data}")
        there = {k: f for k, f in (known["folders"] if known else {}).items() if int(k) not in touched}
        there |= {str(k): f"{data}/{BUCKET}={k}" for k in touched if exists(spark, f"{path}/{data}/{BUCKET}={k}")}
        body = json.dumps({"buckets": buckets, "folders": there, "schema": done.ok.schema.json()})
        touch(spark, f"{aside}/_SUCCESS")
        touch(spark, f"{aside}/{MANIFEST}", body)
    else:
        done.ok.write.parquet(aside)
    if batch is not None:
        touch(spark, f"{aside}/_BATCH_{batch}")
    publish(spark, aside, f"{path}/v={number + 1}")
    return done.errors


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: The column that deals rows to folders, and the file in a version that lists them.
BUCKET, MANIFEST = "__bucket", "manifest.json"


def bucket_of(df: DataFrame, keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*[col(k).cast("string") for k in keys]), F.lit(n)).cast("int")


def changed_buckets(df: DataFrame, config: dict, n: int) -> list[int]:
    """The buckets that changes fall into: at most ``n`` numbers."""
    keys = names_of(need(config, "primary_key", "table"))
    rows = cdc.delete_keys(df, keys) if META in df.columns else df
    return sorted(r[0] for r in rows.select(bucket_of(rows, keys, n)).distinct().collect())


def manifest(spark: SparkSession, path: str, number: int) -> dict | None:
    """The folders of a version of a table in buckets; None for others."""
    where = f"{path.rstrip('/')}/v={number}/{MANIFEST}"
    return json.loads("".join(r[0] for r in spark.read.text(where, wholetext=True).collect())) if exists(spark, where) else None


def touch(spark: SparkSession, path: str, text: str = "") -> None:
    where, fs = _hadoop(spark, path)
    out = fs.create(where)
    out.write(bytearray(text.encode()))
    out.close()


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes what only versions before the last ``keep`` hold. Readers of those versions fail from then on."""
    path = path.rstrip("/")
    jvm = spark.sparkContext._jvm
    where, fs = _hadoop(spark, path)
    numbers = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(where) if s.getPath().getName().startswith("v="))
    used = {f for n in numbers[-keep:] for f in (manifest(spark, path, n) or {"folders": {}})["folders"].values()}
    for n in numbers[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v={n}"), True)
    if not exists(spark, f"{path}/data"):
        return
    for write_ in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/data")):
        for s in fs.listStatus(write_.getPath()):
            name = f"data/{write_.getPath().getName()}/{s.getPath().getName()}"
            if s.getPath().getName().startswith(BUCKET) and name not in used:
                fs.delete(s.getPath(), True)


def publish(spark: SparkSession, aside: str, path: str) -> None:
    """Gives a folder its name; fails, and deletes it, where the name is taken."""
    context = spark.sparkContext
    jvm = context._jvm
    where, fs = _hadoop(spark, aside)
    options = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(where), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)
    except Exception as e:
        fs.delete(where, True)
        raise RuntimeError(f"{path}: another writer took this version; try again") from e


def _database(name: str):
    @sink(name)
    def write_database(df: DataFrame, config: dict) -> DataFrame | None:
        return stores.database(df, config, {"postgresql": "postgres"}.get(name, name))

    return write_database


for _name in ("mysql", "postgres", "postgresql", "sqlite", "doris", "clickhouse"):
    _database(_name)


@sink("redis")
def redis(df: DataFrame, config: dict) -> DataFrame | None:
    return stores.redis(df, config)


@sink("elasticsearch", "es")
def search(df: DataFrame, config: dict) -> DataFrame | None:
    return stores.search(df, config)


@sink("maxcompute", "odps")
def partitioned(df: DataFrame, config: dict) -> None:
    """Replaces partitions of an external table's folder; the service itself is not served."""
    if config.get("mode", "partition_overwrite") != "partition_overwrite" or not config.get("path"):
        raise ConfigError("maxcompute: only partitions of an external table's folder (path) can be written")
    overwrite_partitions(df, config)


def current_version(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The newest complete version of a table and its number; 0 where there is none."""
    if not exists(spark, path):
        return None, 0
    jvm = spark.sparkContext._jvm
    where, fs = _hadoop(spark, path)
    numbers = []
    for s in fs.listStatus(where):
        name = s.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            numbers.append(int(name[2:]))
    if not numbers:
        return None, 0
    newest = max(numbers)
    if found := manifest(spark, path, newest):
        schema = T.StructType.fromJson(json.loads(found["schema"]))
        folders = [f"{path.rstrip('/')}/{f}" for f in found["folders"].values()]
        return (spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)), newest
    return spark.read.parquet(f"{path.rstrip('/')}/v={newest}"), newest


def final_view(versions: DataFrame, keys: list[str], order: str = "_version", deleted: str | None = None) -> DataFrame:
    """The newest version of each key, without those that are deleted."""
    from riverloom.operators.rows import first_of

    out = first_of(versions, keys, order, last=True)
    return out.where(~F.coalesce(col(deleted), F.lit(False))) if deleted else out


def overwrite_partitions(df: DataFrame, config: dict) -> None:
    """Replaces exactly the partitions that the rows name; a null partition value is an error."""
    names = need(config, "partition_by", "partition_overwrite")
    for name, value in (config.get("static_partition") or {}).items():
        df = df.withColumn(name, F.lit(value))
    rows = live_rows(df)
    for c in names:
        rows = rows.withColumn(c, F.when(col(c).isNull(), F.raise_error(F.lit(f"partition value {c} is missing"))).otherwise(col(c)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(need(config, "path", "partition_overwrite"))


@sink("jdbc")
def jdbc(df: DataFrame, config: dict) -> DataFrame | None:
    """Appends rows through a JDBC driver; with a ``dialect``, changes are merged through that database's client."""
    if config.get("dialect"):
        if config["dialect"] not in stores.DIALECTS:
            raise ConfigError(f"jdbc: no dialect {config['dialect']!r}")
        return stores.database(df, config, config["dialect"])
    if config.get("mode", "append") not in ("append", "overwrite"):
        raise ConfigError(f"jdbc: mode {config['mode']!r} needs a dialect")
    options = {k: str(config[k]) for k in ("url", "user", "password", "driver", "batchsize") if config.get(k)}
    live_rows(df).write.format("jdbc").options(dbtable=need(config, "table", "jdbc"), **options).mode(config.get("mode", "append")).save()
    return None


def messages(df: DataFrame, config: dict) -> DataFrame:
    """(topic, key, value): a Debezium-like envelope or the row as JSON; the key from a column or the change data."""
    body = cdc.debezium_json(df) if config.get("format", "envelope") == "envelope" and META in df.columns else F.to_json(F.struct(*[col(c) for c in payload(df)]))
    name = config.get("key_column")
    key: Column = V.text(col(name), V.dtype(df, name)) if name else F.col(f"{META}.key") if META in df.columns else F.lit(None).cast("string")
    topic: Column = F.lit(config.get("topic", ""))
    form = config.get("topic_template")
    if form:
        parts = re.split(r"(\{database\}|\{table\})", form)
        known = {"{database}": F.coalesce(F.col(f"{META}.database"), F.lit("")), "{table}": F.coalesce(F.col(f"{META}.table"), F.lit(""))}
        topic = F.concat(*[known.get(x, F.lit(x)) for x in parts if x])
    return df.select(topic.alias("topic"), key.alias("key"), body.alias("value"))


@sink("kafka")
def kafka(df: DataFrame, config: dict) -> None:
    messages(df, config).write.format("kafka").option("kafka.bootstrap.servers", ",".join(need(config, "brokers", "kafka"))).save()


__all__ = ["BEFORE", "final_view", "messages", "write"]
