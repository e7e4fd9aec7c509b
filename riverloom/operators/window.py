"""Tumbling event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverloom.functions import values as V
from riverloom.functions.predicates import ConfigError
from riverloom.operators.outcome import META, Context, operator, whole
from riverloom.operators.project import col

#: Seconds from year 1 to the epoch: windows are aligned to the start of year 1.
YEAR_ONE = 62_135_596_800
DEFAULT_SIZE = 60


def event_time(df: DataFrame, config: dict, context: Context) -> Column:
    """The configured event-time column, the change data's time, or now."""
    name = config.get("event_time") or context.event_time
    if name:
        if name not in df.columns:
            raise ConfigError(f"window: no column {name}")
        return V.time(col(name), V.dtype(df, name))
    if META in df.columns and "ts" in V.dtype(df, META).names:
        return F.coalesce(F.col(f"{META}.ts").cast("timestamp"), context.time_now())
    return context.time_now()


def offset_seconds(size: int) -> int:
    """Where a window that is aligned to year 1 begins within the epoch's windows."""
    return -YEAR_ONE % size


def aggregate(df: DataFrame, spec: dict, seq: str | None) -> Column:
    func = spec.get("func") or spec.get("function") or "count"
    name = spec.get("field")
    alias = spec.get("alias") or spec.get("as") or (func if func == "count" else f"{func}_{name}")
    if func == "count":
        return F.count(F.lit(1)).alias(alias)
    if not name or name not in df.columns:
        raise ConfigError(f"window: {func} needs a field, not {name!r}")
    c, kind = col(name), V.dtype(df, name)
    n = V.whole_number(c, kind)  # text that is a number counts, decimals included
    zero = F.lit(0.0)
    if func == "sum":
        return F.coalesce(F.sum(n), zero).alias(alias)
    if func == "avg":
        return F.coalesce(F.avg(n), zero).alias(alias)
    if func == "min":
        return F.coalesce(F.min(n), zero).alias(alias)
    if func == "max":
        return F.coalesce(F.max(n), zero).alias(alias)
    if func in ("first", "last"):
        if not seq:
            raise ConfigError(f"window: {func} needs an order column (seq)")
        if func == "first":
            return F.min_by(c, F.when(c.isNotNull(), col(seq))).alias(alias)
        return F.max_by(c, col(seq)).alias(alias)
    raise ConfigError(f"window: no aggregate {func!r}")


@operator("window")
def window(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """Groups by window and keys; one row per window and group.

    With ``allowed_lateness_seconds`` rows older than the newest event less that time are dropped: in a stream by a
    watermark, in a batch by the order column, as each row is compared with those before it.
    """
    kind = config.get("window_type", config.get("type", "tumbling"))
    if kind != "tumbling":
        raise ConfigError(f"window: {kind} windows are not supported")
    size = whole(config, "window_size_seconds", DEFAULT_SIZE) or DEFAULT_SIZE
    if size < 0:
        raise ConfigError("window: the size is positive")
    late = whole(config, "allowed_lateness_seconds", 0) or 0
    keys = [c for c in config.get("group_by") or [] if c in df.columns]
    seq = config.get("seq") or context.seq
    work = df.withColumn("__ts", event_time(df, config, context))
    if context.streaming:
        work = work.withWatermark("__ts", f"{late} seconds")
    elif late > 0:
        work = on_time(work, late, seq)
    frame = F.window("__ts", f"{size} seconds", startTime=f"{offset_seconds(size)} seconds")
    aggregates = [aggregate(df, a, seq) for a in config.get("aggregates") or [{"func": "count"}]]
    out = work.groupBy(frame.alias("__w"), *[col(k) for k in keys]).agg(*aggregates)
    names = [c for c in out.columns if c != "__w"]
    bounds = [V.rfc3339(F.col(f"__w.{x}")).alias(f"window_{x}") for x in ("start", "end")]
    return out.select(*bounds, *[col(c) for c in names])


def on_time(df: DataFrame, late: int, seq: str | None) -> DataFrame:
    """Rows that are not older than the newest event so far less ``late`` seconds.

    The newest event so far is a running maximum over the whole input. It is taken in two steps, so that no task holds
    all rows: per slice of the order column, and over the slices' maxima. Slices have about equally many rows.
    """
    from pyspark.sql import Window

    from riverloom.operators.rows import slices

    if not seq:
        raise ConfigError("window: lateness in a batch needs an order column (seq)")
    if not isinstance(V.dtype(df, seq), T.NumericType):
        raise ConfigError("window: the order column is a number")
    cut = df.withColumn("__slice", slices(df, seq, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    tops = cut.groupBy("__slice").agg(F.max("__ts").alias("__top"))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__slice", F.max("__top").over(before).alias("__before"))
    here = Window.partitionBy("__slice").orderBy(col(seq)).rowsBetween(Window.unboundedPreceding, 0)
    seen = cut.join(tops, "__slice").withColumn("__seen", F.greatest(F.max("__ts").over(here), "__before"))
    kept = seen.where(F.col("__ts") >= F.col("__seen") - F.make_dt_interval(secs=F.lit(late)))
    return kept.drop("__slice", "__before", "__seen")
