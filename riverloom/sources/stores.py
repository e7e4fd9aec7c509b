"""Sinks that write to stores through their Python clients, a transaction per partition.

A client is a function ``module:name`` that the executors can import: for databases one that returns a DB-API
connection, for Redis one that returns a client, for search a function that posts a body. Each store has a default,
which needs that store's package. Changes are reduced to the last one of each key before they are written, rows of a
key go to one partition, and the number of partitions is fixed, so a batch that is written again meets what it wrote.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverloom.functions import values as V
from riverloom.functions.predicates import ConfigError
from riverloom.operators import cdc
from riverloom.operators.outcome import BEFORE, META, Context, Outcome, need, split
from riverloom.operators.project import col
from riverloom.operators.rows import first_of, payload
from riverloom.sources import typing

#: Rows of one statement or request, and partitions that are written side by side.
CHUNK, PARTITIONS = 1000, 8
#: The table that remembers which partitions of which batches were added.
BATCHES = "riverloom_batches"


@dataclass(frozen=True)
class Dialect:
    """How a store quotes names, marks parameters, and merges rows."""

    name: str
    quote: str
    mark: str
    merge: str  # duplicate, conflict, replace or versions
    client: str

    def q(self, name: str) -> str:
        return ".".join(self.quote + p.replace(self.quote, self.quote * 2) + self.quote for p in name.split("."))


DIALECTS = {
    "mysql": Dialect("mysql", "`", "%s", "duplicate", "pymysql:connect"),
    "postgres": Dialect("postgres", '"', "%s", "conflict", "psycopg:connect"),
    "sqlite": Dialect("sqlite", '"', "?", "conflict", "sqlite3:connect"),
    "doris": Dialect("doris", "`", "%s", "replace", "pymysql:connect"),
    "clickhouse": Dialect("clickhouse", "`", "%s", "versions", "clickhouse_driver.dbapi:connect"),
}
#: Types of new columns by dialect, from Spark's types.
COLUMN_TYPES = {
    "mysql": {"bigint": "BIGINT", "int": "INT", "double": "DOUBLE", "boolean": "TINYINT(1)", "timestamp": "DATETIME(3)", "date": "DATE", "string": "TEXT", "binary": "BLOB"},
    "postgres": {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP(3)", "date": "DATE", "string": "TEXT", "binary": "BYTEA"},
    "sqlite": {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "INTEGER", "timestamp": "TEXT", "date": "TEXT", "string": "TEXT", "binary": "BLOB"},
    "doris": {"bigint": "BIGINT", "int": "INT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "DATETIME", "date": "DATE", "string": "STRING", "binary": "STRING"},
    "clickhouse": {"bigint": "Int64", "int": "Int32", "double": "Float64", "boolean": "UInt8", "timestamp": "DateTime64(3)", "date": "Date", "string": "String", "binary": "String"},
}


def load(path: str) -> Callable:
    module, _, name = path.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except ModuleNotFoundError as e:
        raise ConfigError(f"no client {path!r}: {e}") from e


def column_type(dialect: str, kind: str, key: bool) -> str:
    names = COLUMN_TYPES[dialect]
    if kind.startswith("decimal"):
        return {"clickhouse": kind.replace("decimal", "Decimal"), "sqlite": "REAL"}.get(dialect, kind.upper())
    plain = {"smallint": "int", "tinyint": "int", "float": "double", "timestamp_ntz": "timestamp"}.get(kind, kind)
    if key and plain == "string" and dialect in ("mysql", "doris"):
        return "VARCHAR(255)"
    name = names.get(plain, names["string"])
    return f"Nullable({name})" if dialect == "clickhouse" and not key else name


def insert_statement(d: Dialect, table: str, columns: list[str], keys: list[str], mode: str, rows: int, numbers: list[str] | None = None) -> str:
    """One statement that inserts ``rows`` rows and merges them with those that are there, as the mode says.

    ``insert`` keeps what is there, ``upsert`` replaces it, ``increment`` adds the columns ``numbers`` to it.
    """
    others = [c for c in columns if c not in keys]
    names = ", ".join(map(d.q, columns))
    marks = ", ".join(["(" + ", ".join([d.mark] * len(columns)) + ")"] * rows)
    new = {"duplicate": "VALUES({})", "conflict": "EXCLUDED.{}"}.get(d.merge, "{}")

    def value(c: str) -> str:
        fresh = new.format(d.q(c))
        if mode != "increment" or c not in (numbers or []):
            return f"{d.q(c)} = {fresh}"
        old = d.q(c) if d.merge == "duplicate" else f"{d.q(table)}.{d.q(c)}"
        return f"{d.q(c)} = COALESCE({old}, 0) + COALESCE({fresh}, 0)"

    if d.merge in ("replace", "versions"):
        if mode == "increment":
            raise ConfigError(f"{d.name}: no increments")
        return f"INSERT INTO {d.q(table)} ({names}) VALUES {marks}"
    changes = ", ".join(map(value, others))
    if d.merge == "duplicate":
        if mode == "insert" or not others:
            return f"INSERT IGNORE INTO {d.q(table)} ({names}) VALUES {marks}"
        return f"INSERT INTO {d.q(table)} ({names}) VALUES {marks} ON DUPLICATE KEY UPDATE {changes}"
    then = "DO NOTHING" if mode == "insert" or not others else f"DO UPDATE SET {changes}"
    return f"INSERT INTO {d.q(table)} ({names}) VALUES {marks} ON CONFLICT ({', '.join(map(d.q, keys))}) {then}"


def delete_statement(d: Dialect, table: str, keys: list[str], rows: int) -> str:
    one = "(" + " AND ".join(f"{d.q(k)} = {d.mark}" for k in keys) + ")"
    return f"DELETE FROM {d.q(table)} WHERE " + " OR ".join([one] * rows)


def reduced(df: DataFrame, config: dict) -> Outcome:
    """A row per key: its last change (``insert``: its first; ``increment``: sums) with ``__delete``.

    Changes without a key fail. The key is a configured one, or, with ``key_schema``, that of the change data.
    """
    if config.get("key_schema"):
        df = cdc.key_from_metadata(df, config["key_schema"])
        keys = T._parse_datatype_string(config["key_schema"]).names
    else:
        keys = need(config, "primary_key", "store")
        keys = [keys] if isinstance(keys, str) else list(keys)
    mode = config.get("mode", "upsert")
    if mode not in ("insert", "upsert", "increment"):
        raise ConfigError(f"store: mode {mode!r}")
    names = payload(df)
    deleted: Column = F.lit(False)
    order = config.get("seq") or "__seq"
    if META in df.columns:
        df = cdc.delete_keys(df, keys).where(F.coalesce(F.col(f"{META}.op"), F.lit("INSERT")) != "DDL")
        deleted = F.coalesce(F.col(f"{META}.op") == "DELETE", F.lit(False))
        if order not in df.columns:
            df = df.withColumn(order, F.col(f"{META}.seq"))
    if order not in df.columns:
        raise ConfigError("store: an order column (seq) or change data is required")
    df = df.withColumn("__delete", deleted)
    none = F.lit(False)
    for k in keys:
        none = none | col(k).isNull()
    out = split(df, F.when(none, "store: a change without a key"), Context(node="store"))
    rows = out.ok
    if mode == "increment":
        sums = []
        for c in names:
            if c not in keys and c != order:
                number = isinstance(rows.schema[c].dataType, T.NumericType)
                sums.append((F.sum(F.when(~F.col("__delete"), col(c))) if number else F.max_by(col(c), col(order))).alias(c))
        one = rows.groupBy(*[col(k) for k in keys]).agg(*sums, F.max_by("__delete", col(order)).alias("__delete"))
        names = [c for c in names if c != order or c in keys]
    else:
        one = first_of(rows, keys, order, last=mode != "insert")
    return Outcome(one.select(*[col(c) for c in names], "__delete", *([col(order).alias("__order")] if order in one.columns else [])), out.errors)


def _plain(value):
    return json.dumps(value, default=str) if isinstance(value, (list, dict)) else value


DONE = "written long, deleted long"


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[dict]]:
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            yield batch.slice(a, most).to_pylist()


def database(df: DataFrame, config: dict, dialect: str) -> DataFrame | None:
    """Writes changes to a database table: insert, upsert, increment and delete; returns the changes that failed.

    ``auto_create`` makes a missing table, ``schema_drift: add_columns`` adds missing columns. DDL in the change data is
    skipped, refused or, translated, applied first (``ddl_policy``: skip, reject, apply). With ``batch``, the number of
    a stream's batch, an increment that was committed is not added again: its partitions are remembered in the table
    ``riverloom_batches`` in the same transaction.
    """
    d = DIALECTS[dialect]
    table, mode = need(config, "table", dialect), config.get("mode", "upsert")
    client, options = config.get("client") or d.client, dict(config.get("connection") or {})
    apply_ddl(df, config, d, client, options)
    if config.get("target_schema") and (wrong := typing.mismatches(df.select(*[col(c) for c in payload(df)]), config["target_schema"])):
        raise ConfigError(f"{dialect}: " + "; ".join(wrong))
    done = reduced(df, config)
    rows = done.ok
    keys = T._parse_datatype_string(config["key_schema"]).names if config.get("key_schema") else config["primary_key"]
    keys = [keys] if isinstance(keys, str) else list(keys)
    names = [c for c in rows.columns if c not in ("__delete", "__order") and not (c.startswith("_") and c not in keys)]
    numbers = [c for c in names if c not in keys and isinstance(rows.schema[c].dataType, T.NumericType)]
    prepare(rows.select(*[col(c) for c in names]), config, d, client, options, keys)
    versions = d.merge == "versions"
    if versions:
        rows = rows.withColumn("_version", F.col("__order").cast("bigint")).withColumn("_deleted", F.col("__delete").cast("int"))
        names = [*names, "_version", "_deleted"]
    batch, sink = config.get("batch"), config.get("name", table)
    n = int(config.get("partitions", PARTITIONS))
    rows = rows.select(*[col(c) for c in names], "__delete").repartition(n, *[col(k) for k in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        connection = load(client)(**options)
        written = deleted = 0
        try:
            cursor = connection.cursor()
            part = TaskContext.get().partitionId()
            if mode == "increment" and batch is not None:
                marks = " AND ".join(f"{d.q(c)} = {d.mark}" for c in ("sink", "batch", "part"))
                cursor.execute(f"SELECT COUNT(*) FROM {d.q(BATCHES)} WHERE {marks}", (sink, batch, part))
                if cursor.fetchone()[0]:
                    return
                cursor.execute(f"INSERT INTO {d.q(BATCHES)} VALUES ({d.mark}, {d.mark}, {d.mark})", (sink, batch, part))
            for chunk in _chunks(batches, CHUNK // max(1, len(names) // 8)):
                gone = [] if versions else [r for r in chunk if r["__delete"]]
                stay = [r for r in chunk if versions or not r["__delete"]]
                if gone:
                    cursor.execute(delete_statement(d, table, keys, len(gone)), tuple(_plain(r[k]) for r in gone for k in keys))
                if stay:
                    cursor.execute(insert_statement(d, table, names, keys, mode, len(stay), numbers), tuple(_plain(r[c]) for r in stay for c in names))
                written, deleted = written + len(stay), deleted + len(gone)
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()
        yield pa.RecordBatch.from_pydict({"written": [written], "deleted": [deleted]})

    if mode == "increment" and batch is not None:
        execute(client, options, [f"CREATE TABLE IF NOT EXISTS {d.q(BATCHES)} (sink VARCHAR(255), batch BIGINT, part INT, PRIMARY KEY (sink, batch, part))"])
    rows.mapInArrow(run, DONE).collect()  # a row per partition
    return done.errors


def execute(client: str, options: dict, statements: list[str]) -> None:
    connection = load(client)(**options)
    try:
        cursor = connection.cursor()
        for s in statements:
            cursor.execute(s)
        connection.commit()
    finally:
        connection.close()


def prepare(rows: DataFrame, config: dict, d: Dialect, client: str, options: dict, keys: list[str]) -> None:
    """Makes the table, or adds columns that it lacks, where the configuration asks for it."""
    table, drift = config["table"], config.get("schema_drift", "ignore")
    if drift not in ("ignore", "fail", "add_columns"):
        raise ConfigError(f"{d.name}: schema_drift {drift!r}")
    if not config.get("auto_create") and drift == "ignore":
        return
    kinds = typing.resolve(rows, config.get("declared_types"), config.get("column_types"))
    types = {c: column_type(d.name, kinds[c], c in keys) for c in rows.columns}
    if config.get("auto_create"):
        extra = {"_version": "Int64", "_deleted": "UInt8"} if d.merge == "versions" else {}
        columns = ", ".join(f"{d.q(c)} {t}" for c, t in {**types, **extra}.items())
        key = ", ".join(map(d.q, keys))
        end = {"clickhouse": f") ENGINE = ReplacingMergeTree(_version) ORDER BY ({key})", "doris": f") UNIQUE KEY ({key}) DISTRIBUTED BY HASH ({key})"}
        execute(client, options, [f"CREATE TABLE IF NOT EXISTS {d.q(table)} ({columns}" + end.get(d.name, f", PRIMARY KEY ({key}))")])
    if drift == "ignore":
        return
    connection = load(client)(**options)
    try:
        cursor = connection.cursor()
        cursor.execute(f"SELECT * FROM {d.q(table)} WHERE 1 = 0")
        there = {x[0] for x in cursor.description}
    finally:
        connection.close()
    new = [c for c in rows.columns if c not in there]
    if new and drift == "fail":
        raise ConfigError(f"schema drift: new columns {new}")
    execute(client, options, [f"ALTER TABLE {d.q(table)} ADD COLUMN {d.q(c)} {types[c]}" for c in new])


def apply_ddl(df: DataFrame, config: dict, d: Dialect, client: str, options: dict) -> None:
    """What becomes of DDL in the change data; statements are applied in their order, and there are few of them."""
    policy = config.get("ddl_policy", "skip")
    if policy not in ("skip", "reject", "apply"):
        raise ConfigError(f"{d.name}: ddl_policy {policy!r}")
    if META not in df.columns or policy == "skip":
        return
    found = df.where(F.col(f"{META}.op") == "DDL").select(F.col(f"{META}.ddl").alias("ddl"), F.col(f"{META}.seq").alias("seq"))
    statements = [r["ddl"] for r in found.orderBy("seq").limit(1001).collect()]
    if statements and policy == "reject":
        raise ConfigError(f"{d.name}: schema change refused: {statements[0]}")
    if len(statements) > 1000:
        raise ConfigError(f"{d.name}: more than 1000 schema changes in one batch")
    dialect = {"postgres": "postgresql", "clickhouse": "clickhouse"}.get(d.name)
    execute(client, options, [cdc.translate_ddl(s, dialect) or s if dialect else s for s in statements])


def redis(df: DataFrame, config: dict) -> DataFrame | None:
    """Rows as hashes, strings or lists under ``key_prefix`` and the text of ``key_field``; deletes remove the key.

    A string is the text of ``value_field``, or the row as JSON; a list gets that text appended, in the order of the
    rows. ``ttl_seconds`` lets keys expire. Rows without a key fail.
    """
    kind = config.get("data_type", "hash")
    if kind not in ("hash", "string", "list"):
        raise ConfigError(f"redis: no data type {kind!r}")
    name, field = need(config, "key_field", "redis"), config.get("value_field")
    if kind == "list" and not field:
        raise ConfigError("redis: value_field is required")
    client, options, ttl = config.get("client") or "redis:Redis", dict(config.get("connection") or {}), config.get("ttl_seconds")
    keys = [name]
    if META in df.columns:
        df = cdc.delete_keys(df, keys)
    names = [c for c in payload(df) if not c.startswith("_")]
    order = config.get("seq") or "__seq"
    if order not in df.columns:
        if META not in df.columns:
            raise ConfigError("redis: an order column (seq) or change data is required")
        df = df.withColumn(order, F.col(f"{META}.seq"))
    deleted = F.coalesce(F.col(f"{META}.op") == "DELETE", F.lit(False)) if META in df.columns else F.lit(False)
    out = split(df.withColumn("__delete", deleted), F.when(col(name).isNull(), f"redis: {name} is null"), Context(node="redis"), leave=(BEFORE,) if BEFORE in df.columns else ())
    rows = out.ok if kind == "list" else first_of(out.ok, keys, order, last=True)
    texts = [V.text(col(c), V.dtype(rows, c)).alias(c) for c in names]
    body = F.to_json(F.struct(*[col(c) for c in names])).alias("__json")
    shown = F.concat(F.lit(config.get("key_prefix", "")), V.text(col(name), V.dtype(rows, name))).alias("__key")
    rows = rows.select(*texts, body, shown, "__delete", col(order).alias("__order"))
    rows = rows.repartition(int(config.get("partitions", PARTITIONS)), "__key").sortWithinPartitions("__order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = load(client)(**options)
        written = deleted = 0
        for chunk in _chunks(batches, CHUNK):
            pipe = db.pipeline()
            for r in chunk:
                key = r["__key"]
                if r["__delete"]:
                    pipe.delete(key)
                    deleted += 1
                    continue
                written += 1
                if kind == "string":
                    pipe.set(key, (r[field] or "") if field else r["__json"], ex=ttl)
                    continue
                if kind == "list":
                    pipe.rpush(key, r[field] or "")
                else:
                    pipe.hset(key, mapping={c: r[c] if r[c] is not None else "" for c in names})
                if ttl:
                    pipe.expire(key, ttl)
            pipe.execute()
        yield pa.RecordBatch.from_pydict({"written": [written], "deleted": [deleted]})

    rows.mapInArrow(run, DONE).collect()  # a row per partition
    return out.errors


def document_id(df: DataFrame, id_column: str | None = None) -> Column:
    """An id column's text, or a digest of table and position, so a replayed row has the same id."""
    digest = F.lit(None).cast("string")
    if META in df.columns:
        digest = F.sha2(F.concat_ws("|", F.col(f"{META}.database"), F.col(f"{META}.table"), F.col(f"{META}.seq").cast("string"), F.col(f"{META}.key")), 256)
    if not id_column:
        return digest
    return F.coalesce(V.text(col(id_column), V.dtype(df, id_column)), digest)


def post(url: str, headers: dict[str, str], body: bytes) -> str:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, body, headers), timeout=60) as answer:
        return answer.read().decode()


def search(df: DataFrame, config: dict) -> DataFrame | None:
    """Documents of a search index by bulk requests; deletes remove them.

    A document's id is the text of ``id_column``, or a digest of the change's table and position. The index is
    ``index``, or the change's table in lower case. An item that the store refuses fails the write.
    """
    url = need(config, "url", "elasticsearch").rstrip("/") + "/_bulk"
    client, headers = config.get("client") or f"{__name__}:post", {"Content-Type": "application/x-ndjson", **(config.get("headers") or {})}
    if META in df.columns:
        df = df.where(F.coalesce(F.col(f"{META}.op"), F.lit("INSERT")) != "DDL")
        if config.get("id_column"):
            df = cdc.delete_keys(df, [config["id_column"]])
    names = [c for c in payload(df) if not c.startswith("_")]
    index: Column = F.lit(config.get("index"))
    if META in df.columns and not config.get("index"):
        index = F.lower(F.col(f"{META}.table"))
    deleted = F.coalesce(F.col(f"{META}.op") == "DELETE", F.lit(False)) if META in df.columns else F.lit(False)
    seq = F.col(f"{META}.seq") if META in df.columns else F.lit(0)
    df = df.withColumn("__id", document_id(df, config.get("id_column"))).withColumn("__index", index)
    out = split(df, F.when(F.col("__id").isNull() | F.col("__index").isNull(), "elasticsearch: a document without an id or an index"), Context(node="elasticsearch"), leave=("__id", "__index"))
    ok = df.where(F.col("__id").isNotNull() & F.col("__index").isNotNull())
    body = F.to_json(F.struct(*[col(c) for c in names]), {"ignoreNullFields": "false"})
    rows = ok.select("__id", "__index", body.alias("__json"), deleted.alias("__delete"), seq.alias("__order"))
    rows = rows.repartition(int(config.get("partitions", PARTITIONS)), "__id").sortWithinPartitions("__order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = load(client)
        written = deleted = 0
        for chunk in _chunks(batches, CHUNK):
            lines = []
            for r in chunk:
                where = {"_index": r["__index"], "_id": r["__id"]}
                lines += [json.dumps({"delete": where})] if r["__delete"] else [json.dumps({"index": where}), r["__json"]]
                written, deleted = written + (not r["__delete"]), deleted + r["__delete"]
            answer = json.loads(send(url, headers, ("\n".join(lines) + "\n").encode()))
            bad = [x for item in answer.get("items", []) for x in item.values() if x.get("error") and x.get("status") != 404]
            if bad:
                raise RuntimeError(f"elasticsearch: {len(bad)} items refused: {bad[0]['error']}")
        yield pa.RecordBatch.from_pydict({"written": [written], "deleted": [deleted]})

    rows.mapInArrow(run, DONE).collect()  # a row per partition
    return out.errors
