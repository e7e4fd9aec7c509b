"""Operators that keep, drop, fail, order or limit rows, and that convert their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverloom.functions import casts
from riverloom.functions import values as V
from riverloom.functions.predicates import ConfigError, check_regex, closed, compile_filter, value_text
from riverloom.operators.outcome import BEFORE, META, Context, Outcome, need, operator, split, whole
from riverloom.operators.project import col


def payload(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (META, BEFORE)]


def order_column(df: DataFrame, config: dict, context: Context, op: str) -> str:
    """The column that says which row came first."""
    name = config.get("seq") or context.seq
    if not name or name not in df.columns:
        raise ConfigError(f"{op}: an order column is required (seq)")
    return name


@operator("type_convert")
def type_convert(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """One target type per field; what cannot be converted becomes null, unknown targets change nothing."""
    for name, target in need(config, "conversions", "type_convert").items():
        cast = casts.CONVERSIONS.get(target)
        if cast and name in df.columns:
            kind = V.dtype(df, name)
            df = df.withColumn(name, casts.TARGETS[cast](casts.to_string(col(name), kind) if cast == "to_string" else col(name), kind))
    return df


@operator("cast")
def cast(df: DataFrame, config: dict, context: Context) -> Outcome:
    """Casts by field; a value that is not null and fails becomes null, drops the row (skip) or fails it."""
    on_error = config.get("on_error", "null")
    if on_error not in ("null", "skip", "fail"):
        raise ConfigError(f"cast: on_error {on_error!r}")
    new: dict[str, Column] = {}
    bad: list[Column] = []
    for name, target in need(config, "fields", "cast").items():
        if name in df.columns:
            c, kind = col(name), V.dtype(df, name)
            new[name] = casts.cast(c, kind, target)
            bad.append(F.when(c.isNotNull() & new[name].isNull(), f"cast: {name} is no {target}"))
    done = [new.get(c, col(c)).alias(c) for c in df.columns]
    if on_error == "null" or not bad:
        return Outcome(df.select(*done))
    message = F.coalesce(*bad)
    if on_error == "skip":
        return Outcome(df.where(message.isNull()).select(*done))
    out = split(df, message, context)
    return Outcome(out.ok.select(*done), out.errors)


@operator("filter")
def filter_(df: DataFrame, config: dict, context: Context) -> Outcome:
    found = compile_filter(config.get("expression") or "", df.schema, bool(config.get("strict_types")))
    if not found.errors:
        return Outcome(df.where(found.keep))
    message = F.coalesce(*[F.when(closed(c), f"filter: {m}") for c, m in found.errors])
    out = split(df, message, context)
    return Outcome(out.ok.where(found.keep), out.errors)


def _length(c: Column, kind: T.DataType) -> Column:
    """Bytes of a text, elements of an array or map."""
    if isinstance(kind, T.StringType):
        return F.octet_length(c)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.size(c)
    return F.octet_length(V.text(c, kind))


def rule_failure(df: DataFrame, rule: dict) -> Column:
    """The message of a row that breaks a rule, else null."""
    name, kind_of_rule = rule["field"], rule.get("type") or rule.get("rule")
    known = name in df.columns
    c = col(name) if known else F.lit(None).cast("string")
    kind = V.dtype(df, name) if known else T.StringType()
    some = c.isNotNull()
    shown = V.text(c, kind)
    if kind_of_rule == "required":
        good = some & (c != "") if isinstance(kind, T.StringType) else some
    elif kind_of_rule == "not_null":
        good = some
    elif kind_of_rule == "regex":
        good = some & shown.rlike(check_regex(rule.get("pattern") or rule.get("value")))
    elif kind_of_rule == "range":
        low, high = rule.get("min"), rule.get("max")
        n = c.cast("double") if V.is_number(kind) else _length(c, kind).cast("double")
        good = some
        if low is not None:
            good = good & (n >= float(low))
        if high is not None:
            good = good & (n <= float(high))
    elif kind_of_rule == "enum":
        good = some & shown.isin([value_text(v) for v in rule.get("values") or []])
    elif kind_of_rule == "length_min":
        good = some & (_length(c, kind) >= int(rule.get("min", rule.get("value", 0))))
    elif kind_of_rule == "length_max":
        good = some & (_length(c, kind) <= int(rule.get("max", rule.get("value", 0))))
    elif kind_of_rule == "type_is":
        good = some & _has_type(c, kind, rule.get("expected") or rule.get("value"))
    else:
        raise ConfigError(f"validate: no rule {kind_of_rule!r}")
    return F.when(~closed(good), rule.get("message") or f"{name}: {kind_of_rule}")


def _has_type(c: Column, kind: T.DataType, expected: str) -> Column:
    if expected == "string":
        return F.lit(isinstance(kind, T.StringType))
    if expected == "bool":
        return F.lit(isinstance(kind, T.BooleanType))
    if expected in ("int", "int64"):
        return F.lit(True) if V.is_integer(kind) else (c == F.floor(c)) if V.is_number(kind) else F.lit(False)
    if expected == "float64":
        return F.lit(isinstance(kind, (T.DoubleType, T.FloatType)))
    raise ConfigError(f"validate: no type {expected!r}")


@operator("validate")
def validate(df: DataFrame, config: dict, context: Context) -> Outcome:
    """Required fields and rules; all failures are collected unless ``fail_immediate``.

    ``on_failure`` is ``error`` or ``dlq`` (the error output, the default) or ``drop``; other words are refused.
    """
    action = config.get("on_failure") or "error"
    if action not in ("error", "dlq", "drop"):
        raise ConfigError(f"validate: on_failure {action!r}")
    failures: list[Column] = []
    for name in config.get("required_fields") or []:
        if name not in df.columns:
            failures.append(F.lit(f"{name}: required"))
            continue
        kind = V.dtype(df, name)
        bad = col(name).isNull()
        if isinstance(kind, T.StringType):
            bad = bad | (col(name) == "")
        elif isinstance(kind, T.ArrayType):
            bad = bad | (F.size(col(name)) == 0)
        failures.append(F.when(closed(bad), f"{name}: required"))
    failures += [rule_failure(df, r) for r in config.get("rules") or []]
    if not failures:
        return Outcome(df)
    if config.get("fail_immediate"):
        message = F.coalesce(*failures)
    else:
        found = F.filter(F.array(*failures), lambda m: m.isNotNull())
        message = F.when(F.size(found) > 0, F.array_join(found, "; "))
    if action == "drop":
        return Outcome(df.where(message.isNull()))
    return split(df, message, context)


@operator("sample")
def sample(df: DataFrame, config: dict, context: Context) -> DataFrame:
    rate = float(config.get("rate", 1.0))
    if not 0 <= rate <= 1:
        raise ConfigError("sample: rate is between 0 and 1")
    seed = whole(config, "seed")
    return df.sample(False, rate, seed) if seed is not None else df.sample(False, rate)


def first_of(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The first or last row of each key; nulls are a key, and rows without an order lose.

    Spark keeps one row per key and task before rows are shuffled (a group limit under the window), so a key with very
    many rows costs no more than others, and columns that nothing reads later are not shuffled.
    """
    by = col(order).desc_nulls_last() if last else col(order).asc_nulls_last()
    window = Window.partitionBy(*[col(k) for k in keys]).orderBy(by)
    return df.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


@operator("distinct")
def distinct(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """One row per value of the fields (all of them by default): the first one where an order column is known."""
    keys = [c for c in config.get("fields") or payload(df) if c in df.columns]
    name = config.get("seq") or context.seq
    if name and name in df.columns and set(keys) < set(payload(df)):
        return first_of(df, keys, name)
    return df.dropDuplicates(keys)


@operator("deduplicate")
def deduplicate(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """The first row of each key.

    In a stream, keys are remembered within the watermark, which ``state_ttl_seconds`` sets on the event time. With ``window_size`` and ``exact_window`` a key counts as
    seen only while it is among that many last kept keys, which needs one ordered pass; see ``streaming.dedup``.
    """
    keys = [c for c in need(config, "keys", "deduplicate") if c in df.columns]
    if context.streaming:
        if context.event_time and config.get("state_ttl_seconds"):
            df = df.withWatermark(context.event_time, f"{whole(config, 'state_ttl_seconds')} seconds")
        return df.dropDuplicatesWithinWatermark(keys)
    if config.get("exact_window"):
        from riverloom.streaming.dedup import fifo_deduplicate

        return fifo_deduplicate(df, keys, order_column(df, config, context, "deduplicate"), whole(config, "window_size", 10_000))
    return first_of(df, keys, order_column(df, config, context, "deduplicate"))


@operator("compact")
def compact(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """The last change of each key and table; rows without a key pass through."""
    keys = need(config, "keys", "compact")
    order = order_column(df, config, context, "compact")
    none = F.lit(True)
    for k in keys:
        none = none & col(k).isNull()
    # rows without a key are groups of their own, so one scan serves both
    work = df.withColumn("__own", F.when(none, F.monotonically_increasing_id()))
    group = [*keys, "__own"]
    if META in df.columns and "table" in V.dtype(df, META).names:
        work = work.withColumn("__table", F.col(f"{META}.table"))
        group.append("__table")
    return first_of(work, group, order, last=True).drop("__table", "__own")


def _down(f: dict) -> bool:
    return str(f.get("order", f.get("direction", "asc"))).lower() == "desc" or bool(f.get("desc"))


def sort_keys(df: DataFrame, fields: list) -> list[Column]:
    out = []
    for f in fields:
        f = {"field": f} if isinstance(f, str) else f
        name = f["field"]
        down = _down(f)
        if name not in df.columns:
            continue
        c, kind = col(name), V.dtype(df, name)
        parts = [V.whole_number(c, kind), c] if isinstance(kind, T.StringType) and f.get("numeric") else [c]
        out += [x.desc_nulls_last() if down else x.asc_nulls_first() for x in parts]
    return out


@operator("sort")
def sort(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """A global order; nulls come first ascending and last descending; ``seq`` keeps equal rows in their order."""
    keys = sort_keys(df, need(config, "fields", "sort"))
    name = config.get("seq") or context.seq
    if name and name in df.columns:
        keys.append(col(name).asc())
    return df.orderBy(*keys)


@operator("limit")
def limit(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """The first rows over the whole input; after a sort this is a top-k."""
    n = whole(config, "n", whole(config, "count", whole(config, "limit")))
    if n is None or n < 0:
        raise ConfigError("limit: n is required")
    return df.limit(n)


def slices(df: DataFrame, order: str, n: int) -> Column:
    """The number, from 0, of a slice of about equally many rows by the order column; nulls are in the first one.

    Cuts are approximate quantiles, found in one pass. Rows with equal values are in one slice.
    """
    shares = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(col(order), shares, 10_000).alias("x")).first()["x"] if shares else []
    cuts = sorted(set(found or []))
    return F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda k, c: k + F.when(col(order) > c, 1).otherwise(0)) if cuts else F.lit(0)


@operator("skip")
def skip(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """All rows but the first ``n`` in the order of ``fields`` and ``seq``, else of the rows as they come.

    With an order whose first column is a number or time, rows are counted in slices of it; whole slices are kept or
    left out, only the slice that holds the last row to skip is numbered, and the rest is put in order side by side.
    Otherwise Spark has to bring the rows into one sequence.
    """
    n = whole(config, "n", whole(config, "count", whole(config, "skip")))
    if n is None or n < 0:
        raise ConfigError("skip: n is required")
    fields = [{"field": f} if isinstance(f, str) else f for f in config.get("fields") or []]
    if config.get("seq") in df.columns and config.get("seq") is not None:
        fields.append({"field": config["seq"]})
    fields = [f for f in fields if f["field"] in df.columns]
    first = V.dtype(df, fields[0]["field"]) if fields else None
    if context.streaming or not isinstance(first, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df.offset(n)
    keys = sort_keys(df, fields)
    number = slices(df, fields[0]["field"], 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = df.withColumn("__slice", -number if _down(fields[0]) else number)
    left, at = n, None
    for r in cut.groupBy("__slice").count().orderBy("__slice").collect():  # a row per slice
        if left < r["count"]:
            at = r["__slice"]
            break
        left -= r["count"]
    if at is None:
        return df.where(F.lit(False))
    line = Window.partitionBy("__slice").orderBy(*keys)
    edge = cut.where(F.col("__slice") == at).withColumn("__n", F.row_number().over(line)).where(F.col("__n") > left)
    rest = cut.where(F.col("__slice") > at).drop("__slice").unionByName(edge.drop("__slice", "__n"))
    return rest.orderBy(*keys)


@operator("router")
def router(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """Sets the route: a column ``_route``, and the route of the change data where the row has it."""
    name, routes = config.get("field"), config.get("routes") or config.get("mapping") or {}
    default = F.lit(config.get("default") or config.get("default_route"))
    out = default
    if name and name in df.columns and routes:
        shown = V.key_text(col(name), V.dtype(df, name))
        for value, route in reversed(list(routes.items())):
            out = F.when(shown == value_text(value), F.lit(route)).otherwise(out)
    df = df.withColumn("_route", out)
    if META in df.columns and "route" in V.dtype(df, META).names:
        df = df.withColumn(META, F.col(META).withField("route", F.col("_route")))
    return df
