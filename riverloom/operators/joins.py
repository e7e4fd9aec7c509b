"""As-of self-join, dimension lookup, and enrichment by query or request."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverloom.functions import values as V
from riverloom.functions.predicates import ConfigError, where_clause
from riverloom.operators.outcome import Context, Outcome, classify, failed, need, operator, split, whole
from riverloom.operators.project import col
from riverloom.operators.rows import order_column, slices
from riverloom.operators.window import event_time

#: Rows of a dimension, and bytes of them as JSON text, up to which it is broadcast; both are checked.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000
#: Bytes of input for which an as-of join adds a slice.
SLICE_BYTES = 32_000_000


@operator("join")
def asof_join(df: DataFrame, config: dict, context: Context) -> Outcome:
    """Each row with the newest earlier row of its key that satisfies ``where`` and is younger than the window.

    Earlier is by the order column, age by event time. Keys meet by their text form. The rows of a key are cut into
    ``slices`` of the order column (by default one for every 32 MB of Spark's estimate of the input, at most as many as
    shuffle partitions): within a slice one window pass finds the last match, and the last one of each slice is handed on to the next over one row per key and slice. So a key that
    holds much of the input is spread, and the result is that of one pass. Rows without a key are spread and match
    nothing. More keys or rows than ``max_buffered_keys`` or ``max_buffered_records`` are refused.
    """
    kind = config.get("join_type", "inner")
    if kind not in ("inner", "left"):
        raise ConfigError(f"join: join_type {kind!r} is not supported")
    key = need(config, "join_key", "join")
    seq = order_column(df, config, context, "join")
    span = whole(config, "join_window_sec", 60)
    prefix = config.get("join_prefix", "joined_")
    on_miss = config.get("on_miss", "drop")
    if on_miss not in ("drop", "dlq", "error"):
        raise ConfigError(f"join: on_miss {on_miss!r}")
    if key not in df.columns:
        raise ConfigError(f"join: no column {key}")
    fields = [c for c in need(config, "join_fields", "join") if c in df.columns]
    shown = V.text(col(key), V.dtype(df, key))
    some = shown.isNotNull() & (shown != "")
    work = df.withColumn("__key", shown).withColumn("__ts", event_time(df, config, context))
    _check_caps(work.where(some), config)
    match = F.struct(F.col("__ts").alias("__t"), *[col(c).alias(c) for c in fields])
    work = work.withColumn("__candidate", F.when(some & where_clause(config.get("where") or "", df.schema), match))
    n = whole(config, "slices") or min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), estimate(df) // SLICE_BYTES + 1)
    cut = slices(df, seq, n) if n > 1 and isinstance(V.dtype(df, seq), T.NumericType) else F.lit(0)
    work = work.withColumn("__slice", F.when(some, cut).otherwise(-1 - F.pmod(F.xxhash64(col(seq)), F.lit(4 * n))))
    work = work.withColumn("__key", F.when(some, F.col("__key")))
    before = Window.partitionBy("__key", "__slice").orderBy(col(seq)).rowsBetween(Window.unboundedPreceding, -1)
    work = work.withColumn("__match", F.last("__candidate", ignorenulls=True).over(before))
    if n > 1:
        last = F.max_by("__candidate", F.when(F.col("__candidate").isNotNull(), col(seq))).alias("__last")
        ends = work.where(some).groupBy("__key", "__slice").agg(last)
        earlier = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("__key", "__slice", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
        work = work.join(ends, ["__key", "__slice"], "left").withColumn("__match", F.coalesce("__match", "__carried"))
    young = F.unix_micros("__ts") - F.unix_micros(F.col("__match.__t")) < span * 1_000_000
    work = work.withColumn("__match", F.when(some & young, F.col("__match")))
    names = [c for c in df.columns if c not in [prefix + f for f in fields]]
    joined = [col(c) for c in names] + [F.col(f"__match.{c}").alias(prefix + c) for c in fields]
    if kind == "left":
        return Outcome(work.select(*joined))
    hit = work.where(F.col("__match").isNotNull()).select(*joined)
    if on_miss == "drop":
        return Outcome(hit)
    missed = work.where(F.col("__match").isNull()).select(*[col(c) for c in df.columns])
    return Outcome(hit, failed(missed, context.node, "data", f"join: no earlier row of the same {key}"))


def _check_caps(rows: DataFrame, config: dict) -> None:
    """Refuses input beyond the caps that a configuration sets on what a join holds."""
    keys, records = whole(config, "max_buffered_keys"), whole(config, "max_buffered_records")
    if not rows.isStreaming and keys and rows.select("__key").distinct().limit(keys + 1).count() > keys:
        raise ConfigError(f"join: state key limit exceeded ({keys})")
    if not rows.isStreaming and records and rows.limit(records + 1).count() > records:
        raise ConfigError(f"join: state record limit exceeded ({records})")


def unique_dimension(dim: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row per key, the last by ``order``; null keys name nothing.

    Rows of a table have no order of their own: where a key has several different rows and no order is given, the query
    fails and asks for one.
    """
    rows = dim.withColumn("__dim", joined_key(dim, keys)).where(F.col("__dim").isNotNull())
    row = F.struct(*[col(c) for c in dim.columns])
    if order:
        return rows.groupBy("__dim").agg(F.max_by(row, col(order)).alias("__row"))
    plain = [f.name for f in dim.schema.fields if not isinstance(f.dataType, T.MapType)]
    h = F.xxhash64(*[col(c) for c in plain], *[F.to_json(col(c)) for c in dim.columns if c not in plain])
    one = rows.groupBy("__dim").agg(F.first(row).alias("__row"), (F.min(h) == F.max(h)).alias("__same"))
    asked = F.raise_error(F.concat(F.lit(f"lookup: {', '.join(keys)} "), F.col("__dim"), F.lit(" has several rows; dim_order is required")))
    return one.select("__dim", F.when(F.col("__same"), F.col("__row")).otherwise(asked).alias("__row"))


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table has few enough rows and bytes to be broadcast; at most ``most`` rows are looked at."""
    size = F.octet_length(F.to_json(F.struct(*[col(c) for c in df.columns]))) + 32
    n, total = df.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= most and total <= most_bytes


def estimate(df: DataFrame) -> int:
    """Spark's estimate of a table's bytes; very large where it has none."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def for_join(df: DataFrame) -> DataFrame:
    """A dimension as a side of a join, to be broadcast where it is small.

    Where Spark's estimate of its size is below its own threshold, Spark broadcasts it by itself; beyond, or where there
    is no estimate, its rows and bytes are looked at.
    """
    size = estimate(df)
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df if size <= most else F.broadcast(df) if small(df) else df


class Snapshots:
    """Dimensions that are loaded again after a time, of which the last good state is kept.

    A context's table may be a function without arguments that loads it. ``refresh_interval_sec`` (300 by default, 0 for
    never) says when a state is too old; where loading fails then, ``on_refresh_error`` tells whether the last good
    state serves on (``pass``, the default) or the batch fails (``error``). A first load that fails always fails.
    """

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock = clock
        self.held: dict[str, tuple[DataFrame, float]] = {}
        self.failures = 0

    def get(self, name: str, load: Callable[[], DataFrame], config: dict) -> DataFrame:
        every = float(config.get("refresh_interval_sec", 300))
        policy = config.get("on_refresh_error", "pass")
        if policy not in ("pass", "error"):
            raise ConfigError(f"lookup: on_refresh_error {policy!r}")
        old = self.held.get(name)
        if old is not None and (every <= 0 or self.clock() - old[1] <= every):
            return old[0]
        try:
            new = load().persist()
            new.count()  # a state counts once it is read as a whole
        except Exception as e:
            self.failures += 1
            if old is None or policy == "error":
                raise ConfigError(f"lookup: refresh of {name} failed: {e}") from e
            return old[0]
        self.held[name] = (new, self.clock())
        if old is not None:
            old[0].unpersist()
        return new


def dimension(config: dict, context: Context, op: str) -> DataFrame:
    """A named table, or the result of a query over the context's tables."""
    table, query = config.get("table"), config.get("query")
    if table:
        if table not in context.tables:
            raise ConfigError(f"{op}: no table {table!r}")
        found = context.tables[table]
        return found if isinstance(found, DataFrame) else context.snapshots.get(table, found, config)
    if not query:
        raise ConfigError(f"{op}: a table or query is required")
    if not context.tables:
        raise ConfigError(f"{op}: no tables to query")
    return run_sql(query, loaded(context, config))


def loaded(context: Context, config: dict) -> dict[str, DataFrame]:
    """The context's tables, those that functions load included."""
    return {k: t if isinstance(t, DataFrame) else context.snapshots.get(k, t, config) for k, t in context.tables.items()}


def run_sql(query: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A query over DataFrames by name, without leaving views behind."""
    for name, df in tables.items():
        query = re.sub(rf"(?i)\b(from|join)\s+`?{re.escape(name)}`?(?![\w.(])", rf"\1 {{{name}}}", query)
    used = {n: d for n, d in tables.items() if "{" + n + "}" in query}
    return next(iter(tables.values())).sparkSession.sql(query, **used)


_ARGUMENT = re.compile(r"=\s*\{\{\s*\.([A-Za-z_]\w*)\s*\}\}")


def correlated(query: str) -> tuple[str, list[str], list[str]]:
    """(query without the conditions on the row, dimension keys, row fields) of ``select ... where key = {{.field}} and ...``.

    Conditions that name no field of the row stay in the query.
    """
    m = re.fullmatch(r"(?is)\s*(select\s.+?)\s+where\s+(.+?)\s*(?:limit\s+1\s*)?;?\s*", query)
    refused = ConfigError("a query per row has the form select ... where key = {{.field}} and ...")
    if not m or re.search(r"(?i)\b(order|group)\s+by\b", m.group(2)):
        raise refused
    keys, fields, rest = [], [], []
    for c in re.split(r"(?i)\s+and\s+", m.group(2)):
        e = re.fullmatch(r"([\w.`]+)\s*=\s*'?\{\{\s*\.([A-Za-z_]\w*)\s*\}\}'?", c.strip())
        if e:
            keys.append(e.group(1).split(".")[-1].strip("`"))
            fields.append(e.group(2))
        elif "{{" in c:
            raise refused
        else:
            rest.append(c.strip())
    if not keys:
        raise refused
    return m.group(1) + (" where " + " and ".join(rest) if rest else ""), keys, fields


def correlated_table(config: dict, context: Context, op: str) -> tuple[DataFrame, list[str], list[str]]:
    query, keys, fields = correlated(need(config, "query", op))
    select, _, rest = re.split(r"(?i)(\sfrom\s)", query, maxsplit=1)
    columns = [c.strip().split(".")[-1].strip("`").lower() for c in select[len("select") :].split(",")]
    more = [] if "*" in columns else [k for k in keys if k.lower() not in columns]
    query = f"{', '.join([select, *more])} from {rest}"
    return run_sql(query, loaded(context, config)), keys, fields


def joined_key(df: DataFrame, names: list[str]) -> Column:
    """The text form of one column or several as a join key; null where one is null or missing."""
    parts = [V.text(col(n), V.dtype(df, n)) if n in df.columns else F.lit(None).cast("string") for n in names]
    if len(parts) == 1:
        return parts[0]
    some = F.lit(True)
    for p in parts:
        some = some & p.isNotNull()
    return F.when(some, F.concat_ws("\u001f", *parts))


def names_of(value: str | list[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


@operator("lookup")
def lookup(df: DataFrame, config: dict, context: Context) -> Outcome:
    """Fields of the dimension's row with an equal key; both modes (cache, query) are one left join.

    A miss passes the row on as it is (``pass``), with the fields null (``null``), or fails it (``dlq``, ``error``).
    The dimension is broadcast where its rows and bytes are few, which is checked; beyond that rows are shuffled by key.
    Of several rows of a key the last by ``dim_order`` counts. See ``Snapshots`` for dimensions that change.
    """
    mode = config.get("mode", "cache")
    on_miss = config.get("on_miss", "pass")
    if on_miss not in ("pass", "null", "dlq", "error"):
        raise ConfigError(f"lookup: on_miss {on_miss!r}")
    if mode == "query" and "{{" in str(config.get("query") or ""):
        dim, dim_keys, keys = correlated_table(config, context, "lookup")
    elif mode in ("cache", "query"):
        dim = dimension(config, context, "lookup")
        keys = names_of(need(config, "key", "lookup"))
        dim_keys = names_of(config.get("dim_key") or keys)
    else:
        raise ConfigError(f"lookup: mode {mode!r}")
    fields = [c for c in config.get("fields") or [c for c in dim.columns if c not in dim_keys]]
    missing = [c for c in [*fields, *dim_keys] if c not in dim.columns]
    if missing:
        raise ConfigError(f"lookup: the dimension has no {missing}")
    one = unique_dimension(dim.select(*dict.fromkeys([*fields, *dim_keys, *([config["dim_order"]] if config.get("dim_order") else [])])), dim_keys, config.get("dim_order"))
    most = whole(config, "max_cache_entries")
    if most is not None and one.limit(most + 1).count() > most:
        raise ConfigError(f"lookup: the dimension has more than {most} rows")
    if not context.streaming:
        one = for_join(one)
    joined = df.withColumn("__key", joined_key(df, keys)).join(one, F.col("__key") == F.col("__dim"), "left")
    hit = F.col("__dim").isNotNull()
    new: dict[str, Column] = {}
    for c in fields:
        found = F.col(f"__row.`{c}`")
        old = col(c) if c in df.columns and on_miss == "pass" else None
        if old is not None and V.dtype(df, c) != V.dtype(dim, c):
            old = old.try_cast(V.dtype(dim, c))
        new[c] = F.when(hit, found).otherwise(old) if old is not None else found
    columns = [new.get(c, col(c)).alias(c) for c in df.columns] + [new[c].alias(c) for c in fields if c not in df.columns]
    if on_miss in ("pass", "null"):
        return Outcome(joined.select(*columns))
    missed = failed(joined.where(~hit).select(*[col(c) for c in df.columns]), context.node, "data", f"lookup: no row for {', '.join(keys)}")
    return Outcome(joined.where(hit).select(*columns), missed)


@operator("enricher")
def enricher(df: DataFrame, config: dict, context: Context) -> Outcome:
    """All rows of a correlated query, or the response of a request, under one field.

    A query gives an array of rows, empty where none match. A request gives its JSON text.
    """
    mode = config.get("mode", config.get("type", "sql"))
    target = config.get("target_field", "enriched")
    if mode == "sql":
        dim, dim_keys, keys = correlated_table(config, context, "enricher")
        names = [c for c in dim.columns]
        rows = dim.withColumn("__dim", joined_key(dim, dim_keys)).where(F.col("__dim").isNotNull())
        one = rows.groupBy("__dim").agg(F.array_sort(F.collect_list(F.struct(*[col(c) for c in names]))).alias("__rows"))
        if not context.streaming:  # all rows of all keys are broadcast
            one = for_join(one)
        joined = df.drop(target).withColumn("__key", joined_key(df, keys)).join(one, F.col("__key") == F.col("__dim"), "left")
        empty = F.array().cast(one.schema["__rows"].dataType)
        return Outcome(joined.withColumn(target, F.coalesce("__rows", empty)).drop("__key", "__dim", "__rows"))
    if mode != "http":
        raise ConfigError(f"enricher: mode {mode!r}")
    return http_enricher(df, config, context, target)


def fetch_url(url: str, headers: dict[str, str], timeout: float) -> str:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers=headers), timeout=timeout) as answer:
        return answer.read().decode()


def with_retry(call: Callable[[], str], attempts: int, first_delay: float) -> str:
    """Tries again after growing pauses, or after the pause that an answer names."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n + 1 == attempts or not (classify(e) in ("transient", "unknown")):
                raise
            told = getattr(e, "headers", None)
            pause = told.get("Retry-After") if told else None
            time.sleep(float(pause) if pause and pause.isdigit() else first_delay * 2**n)
    raise AssertionError


_FIELD = re.compile(r"\{\{\s*\.([A-Za-z_]\w*)\s*\}\}")


def filled(form: str, row: dict, encode: Callable[[str], str]) -> str:
    """A template with the row's values, each encoded for the place where it stands; null is empty."""
    return _FIELD.sub(lambda m: "" if (v := row.get(m.group(1))) is None or v != v else encode(str(v)), form)


def _one_line(value: str) -> str:
    """A header's value ends no line."""
    return re.sub(r"[\r\n]+", " ", value)


def http_enricher(df: DataFrame, config: dict, context: Context, target: str) -> Outcome:
    """One request per row with bounded concurrency; equal requests of a batch are sent once.

    The address and the headers are templates; values in the address are percent-encoded.
    """
    url = need(config, "url", "enricher")
    fetch = context.functions.get(config.get("client", "")) or fetch_url
    given = {str(k): str(v) for k, v in (config.get("headers") or {}).items()}
    timeout = float(config.get("timeout_sec", 10))
    workers, attempts = int(config.get("max_concurrency", 8)), int(config.get("max_retries", 3))
    names = list(dict.fromkeys(_FIELD.findall(" ".join([url, *given.values()]))))
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ConfigError(f"enricher: no columns {missing}")
    pass_errors = config.get("on_error", "pass") == "pass"

    def run(batches):
        for pdf in batches:
            asked = []
            for row in pdf[names].astype(object).to_dict("records") if names else [{}] * len(pdf):
                heads = tuple((k, filled(v, row, _one_line)) for k, v in given.items())
                asked.append((filled(url, row, lambda v: quote(v, safe="")), heads))

            def one(u):
                try:
                    body = with_retry(lambda: fetch(u[0], dict(u[1]), timeout), attempts, float(config.get("retry_delay_sec", 0.1)))
                    json.loads(body)
                    return body, None
                except Exception as e:
                    return None, f"enricher: {e}"

            distinct = list(dict.fromkeys(asked))
            with ThreadPoolExecutor(workers) as pool:
                got = dict(zip(distinct, pool.map(one, distinct), strict=True))
            pdf[target] = [got[u][0] for u in asked]
            pdf["__failed"] = [got[u][1] for u in asked]
            yield pdf

    base = df.drop(target)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    found = base.mapInPandas(run, f"{fields}, `{target}` string, __failed string")
    if pass_errors:
        return Outcome(found.drop("__failed"))
    out = split(found, F.col("__failed"), context, "transient", leave=("__failed",))
    out.shared = found
    return out
