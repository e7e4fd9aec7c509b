"""Projection: choosing, renaming, adding and rewriting columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverloom.functions import values as V
from riverloom.functions.predicates import ConfigError, check_regex, value_text
from riverloom.operators.outcome import BEFORE, META, Context, Outcome, need, operator, split


def own(df: DataFrame) -> list[str]:
    """The columns that carry the row's change data, which projections never drop."""
    return [c for c in (META, BEFORE) if c in df.columns]


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def constant(value) -> Column:
    if isinstance(value, (list, dict)):
        raise ConfigError("constants are single values")
    return F.lit(value)


@operator("project", "select_fields")
def project(df: DataFrame, config: dict, context: Context) -> Outcome:
    """keep_unmapped, then fields, mappings (moving when kept), constants, and time_formats, in this order.

    Mappings all read the input, so their order does not matter; two with one target are refused. A time that cannot
    be read fails the row.
    """
    mappings: dict[str, str] = dict(config.get("mappings") or {})
    keep = bool(config.get("keep_unmapped"))
    if len(set(mappings.values())) < len(mappings):
        raise ConfigError("project: two mappings have one target")
    out: dict[str, tuple[Column, T.DataType]] = {}
    if keep:
        out |= {c: (col(c), V.dtype(df, c)) for c in df.columns}
    for c in config.get("fields") or []:
        if c in df.columns:
            out[c] = (col(c), V.dtype(df, c))
    present = {a: b for a, b in mappings.items() if a in df.columns}
    if keep:
        for a, b in present.items():
            if a != b and a not in present.values():
                out.pop(a, None)
    for a, b in present.items():
        out[b] = (col(a), V.dtype(df, a))
    for name, value in (config.get("constants") or {}).items():
        out[name] = (constant(value), T.StringType())
        if isinstance(value, bool):
            out[name] = (constant(value), T.BooleanType())
        elif isinstance(value, (int, float)):
            out[name] = (constant(value), T.DoubleType())
    bad: list[Column] = []
    for name, layout in (config.get("time_formats") or {}).items():
        if name in out:
            c, kind = out[name]
            ts = V.time(c, kind)
            bad.append(F.when(c.isNotNull() & ts.isNull(), f"project: {name} is not a time"))
            out[name] = (V.format_time(ts, layout), T.StringType())
    for c in own(df):
        out.setdefault(c, (col(c), V.dtype(df, c)))
    columns = [c.alias(n) for n, (c, _) in out.items()]
    if not bad:
        return Outcome(df.select(*columns))
    marked = df.withColumn("__bad", F.coalesce(*bad))
    done = split(marked, F.col("__bad"), context, leave=("__bad",))
    return Outcome(done.ok.select(*columns), done.errors)


@operator("rename")
def rename(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """All renames at once; a target that exists and is not itself renamed is overwritten."""
    mappings = {a: b for a, b in need(config, "mappings", "rename").items() if a in df.columns}
    if len(set(mappings.values())) < len(mappings):
        raise ConfigError("rename: two mappings have one target")
    gone = {b for b in mappings.values() if b in df.columns and b not in mappings}
    return df.select(*[col(c).alias(mappings.get(c, c)) for c in df.columns if c not in gone])


@operator("drop_field")
def drop_field(df: DataFrame, config: dict, context: Context) -> DataFrame:
    return df.drop(*(config.get("fields") or []))


@operator("add_field")
def add_field(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """A constant text, the current time ({{now}}) or the current epoch seconds ({{ts}})."""
    name, value = need(config, "field", "add_field"), config.get("value", "")
    if value in ("{{now}}", "{{.Now}}"):
        new = V.rfc3339(context.time_now())
    elif value in ("{{ts}}", "{{.Timestamp}}"):
        new = F.unix_timestamp(context.time_now())
    else:
        new = F.lit(value_text(value))
    return df.withColumn(name, new)


@operator("identity", "fanout", "rate_limiter")
def identity(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """No-op. Fan-out comes from edges; a rate is an option of a streaming source (see ``streaming.runner``)."""
    return df


@operator("coalesce")
def coalesce(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """The first field that is not empty (null, empty text, false, zero, empty array) goes to the target."""
    names = [c for c in need(config, "fields", "coalesce") if c in df.columns]
    target = need(config, "target_field", "coalesce")
    kinds = [V.dtype(df, c) for c in names] + ([V.dtype(df, target)] if target in df.columns else [])
    one = len({k.simpleString() for k in kinds}) <= 1 or all(V.is_number(k) for k in kinds)
    form = (lambda c, k: c) if one else V.text
    parts = [F.when(~V.is_empty(col(c), V.dtype(df, c)), form(col(c), V.dtype(df, c))) for c in names]
    if target in df.columns:
        parts.append(form(col(target), V.dtype(df, target)))
    return df.withColumn(target, F.coalesce(*parts) if parts else F.lit(None).cast("string"))


@operator("map_fields")
def map_fields(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """Recode by a dictionary over the text form; a miss gives the default, or by ``on_missing`` the value or null."""
    for rule in need(config, "fields", "map_fields"):
        name = rule["field"]
        if name not in df.columns:
            continue
        kind = V.dtype(df, name)
        table = rule.get("map") or {}
        pairs = [F.lit(x) for k, v in table.items() for x in (value_text(k), None if v is None else value_text(v))]
        key = V.key_text(col(name), kind)
        hit = F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")
        known = key.isin([value_text(k) for k in table]) if table else F.lit(False)
        if "default" in rule:
            miss = F.lit(None if rule["default"] is None else value_text(rule["default"]))
        elif rule.get("on_missing", "keep") == "null":
            miss = F.lit(None).cast("string")
        else:
            miss = V.text(col(name), kind)
        df = df.withColumn(name, F.when(known, hit).otherwise(miss))
    return df


_PLACE = re.compile(r"\{\{\s*\.([A-Za-z_][A-Za-z0-9_]*)\s*\}\}")


def template(df: DataFrame, source: str) -> Column:
    """Text with {{.field}} places; other template syntax is refused."""
    if "{{" in _PLACE.sub("", source):
        raise ConfigError(f"template {source!r}: only {{{{.field}}}} is supported")
    parts, at = [], 0
    for m in _PLACE.finditer(source):
        if m.start() > at:
            parts.append(F.lit(source[at : m.start()]))
        name = m.group(1)
        known = name in df.columns
        parts.append(F.coalesce(V.text(col(name), V.dtype(df, name)), F.lit(V.NIL)) if known else F.lit("<no value>"))
        at = m.end()
    if at < len(source):
        parts.append(F.lit(source[at:]))
    return F.concat(*parts) if parts else F.lit("")


@operator("extract")
def extract(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """A group of a pattern's first match in a text, or a template; without a match the target stays as it is."""
    for rule in need(config, "rules", "extract"):
        target = need(rule, "target", "extract")
        pattern, form = rule.get("pattern"), rule.get("template")
        if bool(pattern) == bool(form):
            raise ConfigError("extract: a rule has either a pattern or a template")
        old = V.text(col(target), V.dtype(df, target)) if target in df.columns else F.lit(None).cast("string")
        if form:
            df = df.withColumn(target, template(df, form))
            continue
        check_regex(pattern)
        source = rule.get("source_field") or target
        if source not in df.columns or not isinstance(V.dtype(df, source), T.StringType):
            if target not in df.columns:
                df = df.withColumn(target, old)
            continue
        group = int(rule.get("group", 0))
        if group > re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern)).groups:
            raise ConfigError(f"extract: {pattern!r} has no group {group}")
        c = col(source)
        df = df.withColumn(target, F.when(c.rlike(pattern) & (c != ""), F.regexp_extract(c, pattern, group)).otherwise(old))
    return df


@operator("mask", "data_masking")
def mask(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """Masks by field: mask_phone, mask_email, mask_id_card, mask_all, hash. Lengths count bytes of ASCII values."""
    for name, strategy in need(config, "fields", "mask").items():
        if name in df.columns:
            value = V.key_text(col(name), V.dtype(df, name))
            df = df.withColumn(name, masked(value, strategy))
    return df


def masked(value: Column, strategy: str) -> Column:
    size = F.octet_length(value)
    ends = lambda stars: F.concat(F.substring(value, 1, 3), F.lit(stars), F.right(value, F.lit(4)))
    at = F.instr(value, "@")
    if strategy == "mask_phone":
        return F.when(size >= 7, ends("*" * 4)).otherwise("****")
    if strategy == "mask_id_card":
        return F.when(size >= 14, ends("*" * 11)).otherwise("****")
    if strategy == "mask_email":
        rest = F.substr(value, at, F.length(value))
        return F.when(at > 2, F.concat(F.substring(value, 1, 1), F.lit("***"), rest)).otherwise("****")
    if strategy == "mask_all":
        return F.lit("********")
    if strategy == "hash":
        return F.lower(F.hex(fnv64(value)))
    return value


#: Offset and prime of the 64-bit FNV hash, and of the 32-bit one.
FNV64 = (14695981039346656037, 1099511628211)
FNV32 = (2166136261, 16777619)


def fnv64(value: Column) -> Column:
    """FNV-1a over the characters of a text, 64 bits wide, as a signed number.

    A running value is kept as two halves of 32 bits, so every product fits a signed 64-bit number.
    """
    low_prime, high_prime = F.lit(FNV64[1] % 2**32), F.lit(FNV64[1] >> 32)
    start = F.struct(F.lit(FNV64[0] >> 32).cast("long").alias("h"), F.lit(FNV64[0] % 2**32).cast("long").alias("l"))
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(acc: Column, ch: Column) -> Column:
        low = acc["l"].bitwiseXOR(F.ascii(ch).cast("long"))
        # the low half times the low prime is below 2**41: the prime's low half is 435
        product = low * low_prime
        high = (acc["h"] * low_prime + low * high_prime + F.shiftright(product, 32)).bitwiseAND(mask)
        return F.struct(high.cast("long").alias("h"), product.bitwiseAND(mask).cast("long").alias("l"))

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.aggregate(chars, start, step, lambda acc: F.shiftleft(acc["h"], 32).bitwiseOR(acc["l"]))


def fnv32(value: Column) -> Column:
    """FNV-1a over the bytes of a text, 32 bits wide, as a number from 0."""
    hexed = F.hex(F.encode(value, "UTF-8"))
    n = F.octet_length(value)
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(acc: Column, i: Column) -> Column:
        byte = F.conv(F.substr(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
        return (acc.bitwiseXOR(byte) * F.lit(FNV32[1])).bitwiseAND(mask).cast("long")

    start = F.lit(FNV32[0]).cast("long")
    return F.when(n == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step))


@operator("add_audit_fields", "field_enrichment")
def add_audit_fields(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """_pipeline, _source_table, _ingested_at and extra constants, where the row has none of that name."""
    new = {
        "_pipeline": F.lit(config.get("pipeline", context.node)),
        "_source_table": F.col(f"{META}.table") if META in df.columns else F.lit(config.get("table", "")),
        "_ingested_at": V.rfc3339(context.time_now()),
        **{k: F.lit(value_text(v)) for k, v in (config.get("extra") or {}).items()},
    }
    for name, c in new.items():
        if name not in df.columns:
            df = df.withColumn(name, c)
    return df


@operator("tap")
def tap(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """Counts rows, and the longest lag behind now where event times are known, as observed metrics."""
    name = config.get("name") or f"tap_{context.node}"
    metrics = [F.count(F.lit(1)).alias("rows")]
    if META in df.columns:
        for op in ("INSERT", "UPDATE", "DELETE", "DDL"):
            metrics.append(F.count_if(F.col(f"{META}.op") == op).alias(op.lower()))
    if context.event_time and context.event_time in df.columns:
        lag = F.unix_timestamp(context.time_now()) - F.unix_timestamp(V.time(col(context.event_time), V.dtype(df, context.event_time)))
        metrics.append(F.max(lag).alias("max_lag_seconds"))
    return df.observe(name, *metrics)
