"""Change data: envelopes, policies, table names, and the state that changes lead to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverloom.functions import values as V
from riverloom.functions.predicates import ConfigError, any_glob, closed, glob_regex
from riverloom.operators.outcome import BEFORE, META, Context, Outcome, operator, split
from riverloom.operators.project import col
from riverloom.operators.rows import first_of, payload

META_TYPE = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("database", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("route", T.StringType()),
        T.StructField("ddl", T.StringType()),
    ]
)
OPS = {"c": "INSERT", "r": "INSERT", "u": "UPDATE", "d": "DELETE"}


def meta(**given: Column) -> Column:
    """A change-data struct; what is not given is null."""
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in META_TYPE.fields])


def with_meta(df: DataFrame, op: Column | str = "INSERT", **given: Column) -> DataFrame:
    return df.withColumn(META, meta(op=F.lit(op) if isinstance(op, str) else op, **given))


def _envelope(df: DataFrame, config: dict) -> tuple[DataFrame, dict[str, Column], T.StructType]:
    """The parts of an envelope that a JSON text column or struct columns hold, and the row image's type."""
    image = config.get("schema")
    source = config.get("column") or ("value" if "value" in df.columns else None)
    if source and isinstance(V.dtype(df, source), T.StringType):
        if not image:
            raise ConfigError("envelope: the schema of the row image is required for JSON text")
        image_type = T._parse_datatype_string(image) if isinstance(image, str) else image
        inner = T.StructType(
            [
                T.StructField("before", image_type),
                T.StructField("after", image_type),
                T.StructField("op", T.StringType()),
                T.StructField("ts_ms", T.LongType()),
                T.StructField("ddl", T.StringType()),
                T.StructField("historyRecord", T.StringType()),
                T.StructField("databaseName", T.StringType()),
                T.StructField("table", T.StringType()),
                T.StructField("snapshot", T.StringType()),
                T.StructField("source", T.StructType([T.StructField(n, T.StringType()) for n in ("db", "database", "table", "snapshot")])),
            ]
        )
        # one schema reads an envelope, a payload in one, and a bare image, unless names of the two meet
        taken = {n.lower() for n in (*inner.names, "payload")}
        meet = any(f.name.lower() in taken for f in image_type.fields)
        corrupt = T.StructField("__corrupt", T.StringType())
        outer = T.StructType([*inner.fields, T.StructField("payload", inner), *([] if meet else image_type.fields), corrupt])
        c = col(source)
        whole = F.trim(c)
        df = V.once(df, "__x", F.from_json(c, outer, {"columnNameOfCorruptRecord": "__corrupt"}))
        parsed = F.col("__x")
        has = parsed["payload"].isNotNull()
        p = {n: F.when(has, parsed["payload"][n]).otherwise(parsed[n]) for n in inner.names}
        bare = F.from_json(c, image_type) if meet else F.struct(*[parsed[f.name].alias(f.name) for f in image_type.fields])
        p["plain"] = F.when(parsed.isNotNull(), bare)
        x = {
            "has": has,
            # a field of another type marks a record as well; only text that is no JSON is unreadable
            "unreadable": c.isNull() | ~whole.startswith("{") | (parsed["__corrupt"].isNotNull() & F.get_json_object(c, "$").isNull()),
            "empty": c.isNull() | whole.isin("", "null") | whole.rlike(r'(?s)^\{\s*("payload"\s*:\s*null\s*,?.*)?\}$'),
        }
        p["tombstone"] = x["empty"] & ~F.coalesce(x["has"], F.lit(False))
        p["unreadable"] = x["unreadable"]
        return df, p, image_type
    if "after" not in df.columns and "before" not in df.columns:
        raise ConfigError("envelope: no JSON column and no before/after columns")
    image_type = V.dtype(df, "after" if "after" in df.columns else "before")
    have = lambda n: col(n) if n in df.columns else F.lit(None)
    p = {n: have(n) for n in ("before", "after", "op", "ts_ms", "ddl", "historyRecord", "databaseName", "table", "snapshot")}
    names = V.dtype(df, "source").names if "source" in df.columns and isinstance(V.dtype(df, "source"), T.StructType) else []
    p["source"] = F.struct(*[(F.col(f"source.{n}") if n in names else F.lit(None)).cast("string").alias(n) for n in ("db", "database", "table", "snapshot")])
    p["plain"] = F.lit(None).cast(image_type)
    p["tombstone"] = F.lit(False)
    p["unreadable"] = F.lit(False)
    return df, p, image_type


def _unwrap(df: DataFrame, config: dict, context: Context, full: bool) -> Outcome:
    keep = config.get("keep_metadata", True)
    df, p, image_type = _envelope(df, config)
    ddl = F.coalesce(p["ddl"].cast("string"), p["historyRecord"].cast("string"))
    ddl = F.when(ddl != "", ddl) if full else F.lit(None).cast("string")
    letter = p["op"].cast("string")
    kind = F.lit("UPDATE")
    for k, v in OPS.items():
        kind = F.when(letter == k, v).otherwise(kind)
    plain = p["after"].isNull() & p["before"].isNull() & letter.isNull() & ddl.isNull()
    kind = F.when(ddl.isNotNull(), "DDL").when(plain, "INSERT").otherwise(kind)
    image = F.when(kind == "DELETE", p["before"]).otherwise(F.coalesce(p["after"], p["before"]))
    image = F.when(plain, p["plain"]).otherwise(image)
    database = F.coalesce(p["source"]["db"], p["source"]["database"], p["databaseName"].cast("string"))
    table = F.coalesce(p["source"]["table"], p["table"].cast("string"))
    ts = F.timestamp_millis(p["ts_ms"].cast("bigint"))
    seq = col(config["seq"]) if config.get("seq") in df.columns else F.lit(None)
    row = F.struct(image.alias("image"), kind.alias("op"), p["before"].alias("before"), closed(p["tombstone"]).alias("tombstone"), closed(p["unreadable"]).alias("unreadable"))
    work = V.once(df, "__y", row)
    work = work.withColumn("__image", F.col("__y.image")).withColumn("__op", F.col("__y.op")).withColumn("__before", F.col("__y.before"))
    work = work.withColumn("__tombstone", F.col("__y.tombstone"))
    work = work.withColumn(META, meta(op=F.col("__y.op"), database=database, table=table, ts=ts, ddl=ddl, seq=seq))
    if keep:
        work = work.withColumn("_op", F.when(ddl.isNotNull(), "ddl").otherwise(letter)).withColumn("_source_table", table)
        work = work.withColumn("_event_time", F.when(ts.isNotNull(), V.rfc3339(ts)))
        if full:
            work = work.withColumn("_debezium_op", F.col("_op")).withColumn("_source_database", database)
            work = work.withColumn("_debezium_snapshot", F.coalesce(p["snapshot"].cast("string"), p["source"]["snapshot"]))
    if full:
        if config.get("skip_tombstone", True):
            work = work.where(~F.col("__tombstone"))
        else:
            work = work.withColumn("_debezium_tombstone", F.col("__tombstone"))
    lost = F.col("__image").isNull() & ~F.col("__tombstone") & (F.col("__op") != "DDL")
    if full:
        lost = lost & (F.col("__op") != "DELETE")
    message = F.when(F.col("__y.unreadable") & ~F.col("__tombstone"), "envelope: not JSON").when(lost, "envelope: an operation without a row image")
    out = split(work, message, context, leave=("__image", "__op", "__before", "__tombstone", *[c for c in ("__x", "__y") if c in work.columns], META))
    ok = work.where(message.isNull())
    extra = [c for c in ("_op", "_source_table", "_event_time", "_debezium_op", "_source_database", "_debezium_snapshot", "_debezium_tombstone") if c in ok.columns]
    names = image_type.names
    return Outcome(
        ok.select(*[F.col(f"__image.`{n}`").alias(n) for n in names], *extra, META, F.col("__before").alias(BEFORE)), out.errors
    )


def change_order(text: Column) -> Column:
    """The order of a change among those of its log, from a Debezium envelope's JSON text, as one whole number.

    MySQL names a log file, whose number grows with every rotation, a position in it, which begins again in each file,
    and a row of an event: file (22 bits), position (33 bits) and row (8 bits, 255 and beyond alike) make the number.
    PostgreSQL names a log sequence number, as a number or as two hexadecimal ones. Without either, a transaction
    number of a GTID counts, then a time. Positions beyond their bits are an error.
    """

    def part(name: str) -> Column:
        return F.coalesce(F.get_json_object(text, f"$.payload.source.{name}"), F.get_json_object(text, f"$.source.{name}"))

    file = F.regexp_extract(part("file"), r"([0-9]+)$", 1).try_cast("bigint")
    at, row = part("pos").try_cast("bigint"), F.least(F.coalesce(part("row").try_cast("bigint"), F.lit(0)), F.lit(255))
    beyond = F.raise_error(F.concat(F.lit("log position out of range: "), part("file"), F.lit(" "), part("pos"))).cast("bigint")
    log = F.when((file >= 1 << 22) | (at >= 1 << 33), beyond).otherwise(F.shiftleft(file, 41) + F.shiftleft(at, 8) + row)
    lsn = part("lsn")
    pair = F.regexp_extract(lsn, r"^([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})$", 1)
    low = F.regexp_extract(lsn, r"^([0-9A-Fa-f]{1,8})/([0-9A-Fa-f]{1,8})$", 2)
    lsn = F.when(pair != "", F.shiftleft(F.conv(pair, 16, 10).cast("bigint"), 32) + F.conv(low, 16, 10).cast("bigint")).otherwise(lsn.try_cast("bigint"))
    gtid = F.regexp_extract(part("gtid"), r":([0-9]+)$", 1).try_cast("bigint")
    time = F.coalesce(F.get_json_object(text, "$.payload.ts_ms"), F.get_json_object(text, "$.ts_ms")).try_cast("bigint")
    return F.coalesce(F.when(file.isNotNull() & at.isNotNull(), log), lsn, at, gtid, time)


@operator("normalize_envelope", "debezium_envelope")
def normalize_envelope(df: DataFrame, config: dict, context: Context) -> Outcome:
    """The after-image (before-image of deletes) as columns, the change data beside it; plain rows pass as inserts."""
    return _unwrap(df, config, context, full=False)


@operator("debezium_cdc")
def debezium_cdc(df: DataFrame, config: dict, context: Context) -> Outcome:
    """As ``normalize_envelope``, with tombstones, DDL events and table names."""
    out = _unwrap(df, config, context, full=True)
    rules, form = config.get("table_mapping") or {}, config.get("table_template")
    if rules or form:
        out.ok = out.ok.withColumn(META, F.col(META).withField("table", mapped_table(out.ok, rules, form)))
    return out


def mapped_table(df: DataFrame, rules: dict[str, str], form: str | None = None, pattern: str | None = None, replacement: str = "") -> Column:
    """A table's new name: a glob of db.table, a glob of the table, a regex replacement, a template, else its own.

    Templates know {source_db}, {source_table}, {YYYYMMDD} and {YYYY-MM-DD}.
    """
    database, table = F.coalesce(F.col(f"{META}.database"), F.lit("")), F.coalesce(F.col(f"{META}.table"), F.lit(""))
    out = table
    if form:
        parts = re.split(r"(\{source_db\}|\{source_table\}|\{YYYYMMDD\}|\{YYYY-MM-DD\})", form)
        day = F.col(f"{META}.ts")
        known = {
            "{source_db}": database,
            "{source_table}": table,
            "{YYYYMMDD}": F.coalesce(F.date_format(day, "yyyyMMdd"), F.lit("")),
            "{YYYY-MM-DD}": F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("")),
        }
        out = F.concat(*[known.get(x, F.lit(x)) for x in parts if x])
    if pattern:
        out = F.when(table.rlike(pattern), F.regexp_replace(table, pattern, re.sub(r"\$\{?(\w+)\}?", r"$\1", replacement))).otherwise(out)
    full = F.concat_ws(".", database, table)
    for qualified in (False, True):
        for glob, target in reversed([(g, t) for g, t in rules.items() if ("." in g) is qualified]):
            where = full if qualified else table
            out = F.when(where.rlike(glob_regex(glob)), F.lit(target)).otherwise(out)
    return out


@operator("table_mapping")
def table_mapping(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """Renames tables of the change data and keeps the old names in _source_table and _source_database."""
    if META not in df.columns:
        raise ConfigError("table_mapping: the rows have no change data")
    new = mapped_table(df, config.get("rules") or {}, config.get("template"), config.get("regex"), config.get("replacement", ""))
    df = df.withColumn("_source_table", F.col(f"{META}.table")).withColumn("_source_database", F.col(f"{META}.database"))
    return df.withColumn(META, F.col(META).withField("table", new))


#: Words that make a DDL statement dangerous where no lists are given.
DANGEROUS = ("drop", "truncate", "alter", "rename")


def dangerous_ddl(ddl: Column, deny: list[str], allow: list[str]) -> Column:
    text = F.lower(F.trim(ddl))
    out = F.lit(False)
    if allow:
        fits = F.lit(False)
        for p in allow:
            fits = fits | closed(ddl.rlike(p))
        out = ~fits
    else:
        for word in DANGEROUS:
            out = out | closed(text.contains(word))
    for p in deny:
        out = out | closed(ddl.rlike(p))
    return out


@operator("cdc_policy", "ddl_guard")
def cdc_policy(df: DataFrame, config: dict, context: Context) -> Outcome:
    """In this order: tombstones, databases and tables by glob, snapshot rows, deletes, DDL."""
    if META not in df.columns:
        raise ConfigError("cdc_policy: the rows have no change data")
    keep = F.lit(True)
    if config.get("skip_tombstone", True) and "_debezium_tombstone" in df.columns:
        keep = keep & ~closed(F.col("_debezium_tombstone"))
    database, table = F.coalesce(F.col(f"{META}.database"), F.lit("")), F.coalesce(F.col(f"{META}.table"), F.lit(""))
    for c, name in ((database, "databases"), (table, "tables")):
        include, exclude = config.get(f"include_{name}") or [], config.get(f"exclude_{name}") or []
        if include:
            keep = keep & any_glob(c, include)
        if exclude:
            keep = keep & ~any_glob(c, exclude)
    if config.get("skip_snapshot") and "_debezium_snapshot" in df.columns:
        keep = keep & closed(~F.col("_debezium_snapshot").isin("true", "last", "first", "first_in_data_collection", "last_in_data_collection") | F.col("_debezium_snapshot").isNull())
    op = F.col(f"{META}.op")
    if config.get("skip_delete") or config.get("delete_policy") == "drop":
        keep = keep & closed(op != "DELETE")
    action = config.get("ddl_policy", config.get("dangerous_ddl", "reject"))
    if action not in ("reject", "drop", "pass"):
        raise ConfigError(f"cdc_policy: ddl_policy {action!r}")
    bad = closed(op == "DDL") & dangerous_ddl(F.coalesce(F.col(f"{META}.ddl"), F.lit("")), config.get("ddl_deny") or [], config.get("ddl_allow") or [])
    kept = df.where(keep)
    if action == "pass":
        return Outcome(kept)
    if action == "drop":
        return Outcome(kept.where(~bad))
    return split(kept, F.when(bad, F.concat(F.lit("cdc_policy: dangerous DDL: "), F.coalesce(F.col(f"{META}.ddl"), F.lit("")))), context, "schema")


def delete_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of deletes are read from the before-image first."""
    if BEFORE not in df.columns:
        return df
    names = V.dtype(df, BEFORE).names
    for k in keys:
        if k in names:
            own = F.when(F.col(f"{META}.op") == "DELETE", F.coalesce(F.col(f"{BEFORE}.`{k}`"), col(k))).otherwise(col(k))
            df = df.withColumn(k, own)
    return df


def key_from_metadata(df: DataFrame, schema: str) -> DataFrame:
    """Primary-key columns from the JSON object that the change data's key holds (a ``payload`` inside it counts)."""
    names = T._parse_datatype_string(schema).names
    wrapped = F.from_json(F.col(f"{META}.key"), f"payload struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in T._parse_datatype_string(schema).fields)}>")
    bare = F.from_json(F.col(f"{META}.key"), schema)
    for n in names:
        df = df.withColumn(n, F.coalesce(wrapped["payload"][n], bare[n]))
    return df


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key."""
    return first_of(delete_keys(changes, keys), keys, order, last=True)


def apply_changes(base: DataFrame, changes: DataFrame, keys: list[str], order: str, mode: str = "upsert") -> Outcome:
    """The table that a base and its changes make: the last change of each key wins, deletes remove.

    ``insert`` keeps rows that are there; ``increment`` adds to the numbers that are there (deletes still remove).
    Changes without a key fail. Base and changes meet in one join on the key. The order column tells which change is
    the last one; see ``change_order`` for changes from a log.
    """
    names = base.columns
    work = delete_keys(changes, keys) if META in changes.columns else changes
    none = F.lit(False)
    for k in keys:
        none = none | col(k).isNull()
    out = split(work, F.when(none, "apply: a change without a key"), Context(node="apply"))
    some = out.ok
    is_delete = F.col(f"{META}.op") == "DELETE" if META in some.columns else F.lit(False)
    if mode == "increment":
        some = some.withColumn("__delete", closed(is_delete))
        sums = [F.sum(F.when(~F.col("__delete"), col(c))).alias(c) for c in names if c not in keys]
        last = some.groupBy(*keys).agg(*sums, F.max_by("__delete", col(order)).alias("__delete"))
    else:
        last = first_of(some.withColumn("__delete", closed(is_delete)), keys, order, last=mode != "insert")
        last = last.select(*names, "__delete")
    fresh = last.select(*[col(c).alias(f"__{c}") for c in names], "__delete", F.lit(True).alias("__new"))
    on = [col(k) == col(f"__{k}") for k in keys]
    condition = on[0]
    for x in on[1:]:
        condition = condition & x
    both = base.withColumn("__old", F.lit(True)).join(fresh, condition, "full")
    new, old = closed(F.col("__new")), closed(F.col("__old"))
    columns = []
    for c in names:
        if c in keys:
            value = F.coalesce(col(c), col(f"__{c}"))
        elif mode == "insert":
            value = F.when(old, col(c)).otherwise(col(f"__{c}"))
        elif mode == "increment":
            value = F.when(new & old, F.coalesce(col(c), F.lit(0)) + F.coalesce(col(f"__{c}"), F.lit(0))).otherwise(F.when(old, col(c)).otherwise(col(f"__{c}")))
        else:
            value = F.when(new, col(f"__{c}")).otherwise(col(c))
        columns.append(value.alias(c))
    gone = new & closed(F.col("__delete"))
    return Outcome(both.where(~gone).select(*columns), out.errors)


def debezium_json(df: DataFrame) -> Column:
    """A change row as a Debezium-like JSON envelope."""
    row = F.struct(*[col(c) for c in payload(df)])
    op = F.col(f"{META}.op")
    letter = F.when(op == "INSERT", "c").when(op == "DELETE", "d").otherwise("u")
    before = F.col(BEFORE) if BEFORE in df.columns else F.lit(None).cast(T.StructType([df.schema[c] for c in payload(df)]))
    source = F.struct(F.col(f"{META}.database").alias("db"), F.col(f"{META}.table").alias("table"))
    return F.to_json(
        F.struct(
            F.when(op == "DELETE", F.coalesce(before, row)).otherwise(before).alias("before"),
            F.when(op != "DELETE", row).alias("after"),
            letter.alias("op"),
            source.alias("source"),
            F.unix_millis(F.col(f"{META}.ts")).alias("ts_ms"),
        )
    )


#: MySQL column types and what they are called elsewhere.
TYPE_NAMES = {
    "postgresql": {
        "tinyint": "SMALLINT",
        "smallint": "SMALLINT",
        "int": "INTEGER",
        "integer": "INTEGER",
        "mediumint": "INTEGER",
        "bigint": "BIGINT",
        "float": "REAL",
        "double": "DOUBLE PRECISION",
        "real": "DOUBLE PRECISION",
        "decimal": "DECIMAL",
        "numeric": "DECIMAL",
        "char": "CHAR",
        "varchar": "VARCHAR",
        "text": "TEXT",
        "tinytext": "TEXT",
        "mediumtext": "TEXT",
        "longtext": "TEXT",
        "blob": "BYTEA",
        "tinyblob": "BYTEA",
        "mediumblob": "BYTEA",
        "longblob": "BYTEA",
        "date": "DATE",
        "datetime": "TIMESTAMP(3)",
        "timestamp": "TIMESTAMP(3)",
        "time": "TIME",
        "json": "JSONB",
        "enum": "TEXT",
        "set": "TEXT",
    },
    "clickhouse": {
        "tinyint": "Int8",
        "smallint": "Int16",
        "int": "Int32",
        "integer": "Int32",
        "mediumint": "Int32",
        "bigint": "Int64",
        "float": "Float32",
        "double": "Float64",
        "real": "Float64",
        "decimal": "Decimal",
        "numeric": "Decimal",
        "date": "Date",
        "datetime": "DateTime64(3)",
        "timestamp": "DateTime64(3)",
    },
}
#: What a type is called that the lists above lack, and types that keep their length or precision.
OTHER_TYPE = {"postgresql": "TEXT", "clickhouse": "String"}
SIZED = {"postgresql": ("decimal", "numeric", "char", "varchar"), "clickhouse": ("decimal", "numeric")}


def translate_ddl(ddl: str, dialect: str) -> str | None:
    """ALTER TABLE ADD, DROP, MODIFY or CHANGE COLUMN of MySQL in another dialect; None for other statements."""
    if dialect not in TYPE_NAMES:
        raise ConfigError(f"no dialect {dialect!r}")
    m = re.fullmatch(r"(?is)\s*alter\s+table\s+([`\w.]+)\s+(add|drop|modify|change)(?:\s+column)?\s+`?(\w+)`?\s*(.*?);?\s*", ddl)
    if not m:
        return None
    table, verb, column, rest = m.group(1).replace("`", ""), m.group(2).lower(), m.group(3), m.group(4).strip()
    new = column
    if verb == "change":
        new, _, rest = rest.partition(" ")
        new = new.strip("`")
    t = re.match(r"(?i)(\w+)\s*(\([^)]*\))?", rest)
    base = t.group(1).lower() if t else ""
    kind = TYPE_NAMES[dialect].get(base, OTHER_TYPE[dialect])
    if t and t.group(2) and base in SIZED[dialect]:
        kind += t.group(2)
    if verb == "drop":
        return f"ALTER TABLE {table} DROP COLUMN {column}"
    if verb == "add":
        return f"ALTER TABLE {table} ADD COLUMN {column} {kind}"
    change = f"ALTER COLUMN {new} TYPE {kind}" if dialect == "postgresql" else f"MODIFY COLUMN {new} {kind}"
    if new == column:
        return f"ALTER TABLE {table} {change}"
    return f"ALTER TABLE {table} RENAME COLUMN {column} TO {new}; ALTER TABLE {table} {change}"
