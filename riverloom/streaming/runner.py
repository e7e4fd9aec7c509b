"""Runs pipelines over streams: file or message sources, operators per micro-batch or stateful, sinks with errors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from riverloom.functions import values as V
from riverloom.functions.predicates import ConfigError
from riverloom.operators.outcome import Context, Outcome, classify, failed, union_errors
from riverloom.operators.project import col
from riverloom.plans.compile import FailedRows, chain
from riverloom.plans.hooks import Hooks
from riverloom.sources import sinks
from riverloom.streaming.control import Breaker, trigger, with_retry

#: State lies in files beside memory, so it may outgrow an executor; set for the session when a stream keeps state.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: Operators that keep state between rows and so run inside the stream, not per batch.
STATEFUL = ("window", "deduplicate", "join")


def file_stream(spark: SparkSession, path: str, schema: str | T.StructType, kind: str = "parquet", **options) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).options(**{k: str(v) for k, v in options.items()}).load(path)


def run_stream(
    df: DataFrame,
    steps: list,
    sink: tuple[str, dict],
    checkpoint: str,
    *,
    context: Context | None = None,
    errors_to: str | None = None,
    options: dict | None = None,
    on_batch: Callable[[int], None] | None = None,
    hooks: Hooks | None = None,
    source_errors: DataFrame | None = None,
    breaker: Breaker | None = None,
) -> StreamingQuery:
    """Starts a pipeline over a stream.

    Steps up to the first stateful one and that one run in the stream, the others in each micro-batch. Failed rows of a
    batch are written to ``errors_to`` as JSON in a folder of the batch, which a batch that runs again replaces; without
    ``errors_to`` they stop the stream. What makes failed rows in the stream itself (``source_errors``, misses of an
    as-of join) is written by a query of its own beside the checkpoint.

    A batch is written again after a failure that may pass. While too many writes in a row have failed, the breaker
    holds the next one back for its time of rest. Where a batch as a whole is refused for its data, its rows are tried
    in halves, and a row that alone is refused goes to ``errors_to``. Offsets are committed after the write. The sink
    learns the batch's number: tables of versions and databases do not take a batch twice, increments included; other
    sinks may see one again.
    """
    context = context or Context()
    hooks = hooks or Hooks()
    live = Context(**{**context.__dict__, "streaming": True})
    names = [s[0] if isinstance(s, tuple) else s.type if hasattr(s, "type") else s.get("type") for s in steps]
    cut = next((i + 1 for i, n in enumerate(names) if n in STATEFUL), 0)
    if any(n in STATEFUL for n in names[cut:]):
        raise ConfigError("a stream has one stateful operator")
    if cut:
        df.sparkSession.conf.set(PROVIDER, ROCKSDB)
    head: Outcome = Outcome(df)
    for step in steps[:cut]:
        name, config = step if isinstance(step, tuple) else (step.type, step.config) if hasattr(step, "type") else (step["type"], step.get("config") or {})
        done = asof_stream(head.ok, config, live) if name == "join" else chain(head.ok, [(name, config)], live)
        head = Outcome(done.ok, union_errors([head.errors, done.errors]))
    aside = union_errors([source_errors, head.errors])
    if aside is not None and not errors_to:
        raise ConfigError("a stream whose rows can fail before its batches needs errors_to")
    breaker = breaker or Breaker()
    kind, config = sink

    def put(rows: DataFrame, number: int) -> DataFrame | None:
        return with_retry(lambda: sinks.write(rows, kind, {**config, "batch": number}))

    def write(batch: DataFrame, number: int) -> None:
        while not breaker.allow():
            time.sleep(min(1.0, breaker.rest / 10))
        hooks.fire("on_pre_batch", str(number))
        batch.persist()
        try:
            done = chain(batch, steps[cut:], context) if steps[cut:] else Outcome(batch)
            if done.errors is not None and not errors_to and not done.errors.isEmpty():
                raise FailedRows(f"batch {number}: rows failed and errors_to names no place for them")
            try:
                refused = put(done.ok, number)
            except Exception as e:
                if classify(e) != "data" or not errors_to:
                    raise
                refused = isolate(done.ok, lambda rows: sinks.write(rows, kind, config), kind)
            failed_ = union_errors([done.errors, refused])
            if failed_ is not None and errors_to:
                failed_.write.mode("overwrite").json(f"{errors_to.rstrip('/')}/batch={number}")
            breaker.success()
        except Exception as e:
            breaker.failure()
            hooks.fire("on_error", str(e))
            raise
        finally:
            batch.unpersist()
        hooks.fire("on_post_batch", str(number))
        hooks.fire("on_checkpoint", str(number))
        if on_batch:
            on_batch(number)

    if aside is not None:
        beside = aside.writeStream.format("json").option("path", f"{errors_to}/stream").option("checkpointLocation", f"{checkpoint.rstrip('/')}-errors")
        beside.outputMode("append").trigger(**trigger(options or {})).start()
    writer = head.ok.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**trigger(options or {})).start()


#: Tries that a batch with refused rows may take; rows in parts that are left then all count as refused.
MOST_TRIES = 200


def isolate(rows: DataFrame, put: Callable[[DataFrame], DataFrame | None], node: str) -> DataFrame | None:
    """Writes rows in halves, until those are alone that a sink refuses; returns them as failed rows.

    Parts are ranges of a hash, so nothing is collected. A part that cannot be divided further, or is left after
    MOST_TRIES, counts as refused.
    """
    work = rows.withColumn("__part", F.pmod(F.xxhash64(*[col(f.name) for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]), F.lit(1 << 30)))
    refused: list[DataFrame | None] = []
    parts, tries = [(0, 1 << 30)], 0
    while parts:
        low, high = parts.pop()
        part = work.where((F.col("__part") >= low) & (F.col("__part") < high)).drop("__part")
        if part.isEmpty():
            continue
        try:
            tries += 1
            if tries > MOST_TRIES:
                raise ValueError("data: too many refused rows in one batch")
            refused.append(put(part))
        except Exception as e:
            if classify(e) != "data" and tries <= MOST_TRIES:
                raise
            if high - low > 1 and tries <= MOST_TRIES and part.limit(2).count() > 1:
                parts += [(low, (low + high) // 2), ((low + high) // 2, high)]
            else:
                refused.append(failed(part, node, "data", str(e)[:500]))
    return union_errors(refused)


class _AsOf(StatefulProcessor):
    """The last candidate of a key, for rows in the order of the sequence within a batch."""

    def __init__(self, span: float, fields: list[str], names: list[str], state: str, prefix: str, ttl: int | None):
        self.span, self.fields, self.names, self.state, self.prefix, self.ttl = span, fields, names, state, prefix, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.state, ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("asof_seq", kind="stable")
        held = self.last.get()
        held = None if held is None else tuple(held)
        out = []
        for row in batch.astype(object).to_dict("records"):
            t = row["asof_time"]
            hit = bool(held is not None and t - held[0] < self.span and key[0])
            found = {self.prefix + f: held[i + 1] if hit else None for i, f in enumerate(self.fields)}
            out.append({**{n: row[n] for n in self.names}, **found, "asof_hit": hit})
            if row["asof_candidate"] and key[0]:
                held = (t, *[None if row[f] is None or row[f] != row[f] else row[f] for f in self.fields])
        if held is not None:
            self.last.update(held)
        yield pd.DataFrame(out, columns=[*self.names, *[self.prefix + f for f in self.fields], "asof_hit"], dtype=object)

    def close(self) -> None:
        pass


def asof_stream(df: DataFrame, config: dict, context: Context) -> Outcome:
    """The as-of self-join over a stream: state holds one candidate per key, with the types of its fields.

    Rows of a micro-batch are taken in the order of ``seq``; a row sees what came before it in earlier batches and in
    its own. Misses of inner joins are dropped, or fail with ``on_miss`` dlq or error, which a query of its own writes
    with a state of its own. State of a key goes after ``state_ttl_seconds`` where that is set.
    """
    from riverloom.functions.predicates import where_clause
    from riverloom.operators.window import event_time

    kind, on_miss = config.get("join_type", "inner"), config.get("on_miss", "drop")
    if kind not in ("inner", "left"):
        raise ConfigError(f"join: join_type {kind!r} is not supported")
    if on_miss not in ("drop", "dlq", "error"):
        raise ConfigError(f"join: on_miss {on_miss!r}")
    key, seq = config["join_key"], config.get("seq") or context.seq
    if not seq:
        raise ConfigError("join: an order column is required (seq)")
    fields = [c for c in config["join_fields"] if c in df.columns]
    prefix, span = config.get("join_prefix", "joined_"), float(config.get("join_window_sec", 60))
    shown = F.coalesce(V.text(col(key), V.dtype(df, key)), F.lit(""))
    micros = F.unix_micros(event_time(df, config, context)) / 1e6
    work = df.withColumn("asof_key", shown).withColumn("asof_time", micros).withColumn("asof_seq", col(seq))
    work = work.withColumn("asof_candidate", where_clause(config.get("where") or "", df.schema))
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    typed = [(f, df.schema[f].dataType.simpleString()) for f in fields]
    out = f"{plain}, " + "".join(f"`{prefix}{f}` {t}, " for f, t in typed) + "asof_hit boolean"
    state = "t double, " + ", ".join(f"f{i} {t}" for i, (_, t) in enumerate(typed))
    ttl = int(1000 * float(config["state_ttl_seconds"])) if config.get("state_ttl_seconds") else None
    processor = _AsOf(span, fields, df.columns, state, prefix, ttl)
    found = work.groupBy("asof_key").transformWithStateInPandas(processor, out, "Append", "ProcessingTime" if ttl else "None")
    if kind == "left":
        return Outcome(found.drop("asof_hit"))
    hit = found.where("asof_hit").drop("asof_hit")
    if on_miss == "drop":
        return Outcome(hit)
    misses = found.where("not asof_hit").select(*[col(c) for c in df.columns])
    return Outcome(hit, failed(misses, context.node or "join", "data", f"join: no earlier row of the same {key}"))
