"""Compiles specifications: a chain or graph of operators becomes DataFrames, failed rows a table beside them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

import riverloom.operators.cdc
import riverloom.operators.code
import riverloom.operators.joins
import riverloom.operators.project
import riverloom.operators.rows
import riverloom.operators.window  # noqa: F401
from riverloom.functions.predicates import ConfigError, edge_condition
from riverloom.operators.outcome import Context, Outcome, apply, union_errors
from riverloom.plans.spec import Graph, Spec, Step, parse, to_graph, topological, validate


def chain(df: DataFrame, steps: list[Step | tuple | dict], context: Context | None = None) -> Outcome:
    """Operators one after another; the errors of all of them together.

    ``skip`` takes the order of the ``sort`` before it, and is put in that order again, so a page is a sort, a skip and
    a limit.
    """
    context = context or Context()
    errors: list[DataFrame | None] = []
    order: dict | None = None
    shared: list[DataFrame] = []
    for i, step in enumerate(steps):
        if isinstance(step, tuple):
            step = Step(*step)
        elif isinstance(step, dict):
            step = Step(step.get("type", ""), step.get("config") or {k: v for k, v in step.items() if k != "type"})
        here = Context(**{**context.__dict__, "node": f"{i}:{step.type}"})
        config = step.config
        if step.type == "skip" and order is not None and not config.get("fields"):
            config = {**config, "fields": order["fields"], "seq": order.get("seq") or context.seq}
        order = step.config if step.type == "sort" else None
        out = apply(df, step.type, config, here)
        df = out.ok
        errors.append(out.errors)
        if out.shared is not None:
            shared.append(out.shared)
    return Outcome(df, union_errors(errors), shared or None)


@dataclass
class Compiled:
    """Sink id → rows that reach it; node id → rows that leave it; failed rows of all nodes.

    ``shared`` are rows that more than one of these are taken from: those of nodes with several edges out, and those
    that user code or a service made. ``query`` is the running query of a stream.
    """

    sinks: dict[str, DataFrame] = field(default_factory=dict)
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    errors: DataFrame | None = None
    shared: list[DataFrame] = field(default_factory=list)
    query: StreamingQuery | None = None


def merge(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def compile_graph(graph: Graph, inputs: dict[str, DataFrame], context: Context | None = None) -> Compiled:
    """Rows go along every edge whose condition holds, and a node receives the union of what its edges bring.

    A condition tests a column, ``_route``, or a field of ``_meta``. ``inputs`` holds a DataFrame per source node.
    """
    validate(graph)
    context = context or Context()
    out = Compiled()
    errors: list[DataFrame | None] = []
    by = {n.id: n for n in graph.nodes}
    for i in topological(graph) or []:
        node = by[i]
        if node.kind == "source":
            if i not in inputs:
                raise ConfigError(f"no input for source {i}")
            out.nodes[i] = inputs[i]
            continue
        parts = []
        for e in graph.edges:
            if e.to == i:
                df = out.nodes[e.from_]
                parts.append(df.where(edge_condition(e.condition, df.schema)) if e.condition else df)
        if not parts:
            raise ConfigError(f"nothing reaches node {i}")
        df = merge(parts)
        if node.kind == "sink":
            out.sinks[i] = out.nodes[i] = df
            continue
        name = node.type or {"merge": "identity"}.get(node.kind, node.kind)
        done = apply(df, name, node.config, Context(**{**context.__dict__, "node": i}))
        out.nodes[i] = done.ok
        errors.append(done.errors)
        if done.shared is not None:
            out.shared.append(done.shared)
    out.shared += [out.nodes[n.id] for n in graph.nodes if sum(e.from_ == n.id for e in graph.edges) > 1]
    out.errors = union_errors(errors)
    return out


def compile_spec(spec: Spec | Graph | dict | str, inputs: DataFrame | dict[str, DataFrame], context: Context | None = None) -> Compiled:
    if not isinstance(spec, (Spec, Graph)):
        spec = parse(spec)
    context = context or Context()
    if spec.options.get("event_time"):
        context.event_time = spec.options["event_time"]
    if spec.options.get("seq"):
        context.seq = spec.options["seq"]
    if isinstance(spec, Spec):
        validate(spec)
        if isinstance(inputs, dict):
            inputs = inputs["source"]
        done = chain(inputs, spec.transforms, context)
        return Compiled({"sink": done.ok}, {"source": inputs, "sink": done.ok}, done.errors, done.shared or [])
    if isinstance(inputs, DataFrame):
        inputs = {n.id: inputs for n in spec.nodes if n.kind == "source"}
    return compile_graph(spec, inputs, context)


def dry_run(spark: SparkSession, record: dict, steps: list, context: Context | None = None, schema: str | None = None) -> dict:
    """One record through a chain: what comes out, and what failed and why."""
    df = spark.createDataFrame([record], schema) if schema else spark.createDataFrame([record])
    done = chain(df, steps, context)
    rows = [r.asDict(recursive=True) for r in done.ok.collect()]
    bad = [r.asDict() for r in done.errors.collect()] if done.errors is not None else []
    return {"records": rows, "errors": bad, "filtered": not rows and not bad}


class FailedRows(RuntimeError):
    """Rows failed and nothing says where they go."""


def run(
    spark: SparkSession,
    spec: Spec | Graph | dict | str,
    context: Context | None = None,
    errors_to: str | None = None,
    drop_errors: bool = False,
    tell=None,
) -> Compiled:
    """Reads the sources, compiles, and writes the sinks of a pipeline.

    Rows that several sinks or the errors share are computed once and kept on executors' disks until the run ends.
    Failed rows, those that a sink could not take included, go to ``errors_to`` as JSON (an option of the specification
    as well). Where neither names a place, failed rows stop the run before a sink is written, unless ``drop_errors``.
    A ``streaming`` schedule starts a query, see ``start``; other schedules run once, and ``control.next_run`` tells
    when they run again.
    """
    from pyspark import StorageLevel

    from riverloom.plans.hooks import Hooks
    from riverloom.sources import sinks, sources

    if not isinstance(spec, (Spec, Graph)):
        spec = parse(spec)
    validate(spec)
    context = context or Context()
    errors_to = errors_to or spec.options.get("errors_to")
    schedule = spec.options.get("schedule")
    if (schedule.get("type") if isinstance(schedule, dict) else schedule) == "streaming":
        return start(spark, spec, context, errors_to=errors_to, tell=tell)
    hooks = Hooks.of(spec.hooks, context.functions)
    hooks.fire("on_init", spec.name)
    graph = to_graph(spec) if isinstance(spec, Spec) else spec
    kept: list[DataFrame] = []
    try:
        inputs, bad = {}, []
        for n in graph.nodes:
            if n.kind == "source":
                found = sources.read(spark, n.type, n.config, context)
                inputs[n.id] = found.ok
                bad.append(found.errors)
        done = compile_spec(graph, inputs, context)
        done.errors = union_errors([*bad, done.errors])
        kept = [df.persist(StorageLevel.DISK_ONLY) for df in done.shared]
        if done.errors is not None and not errors_to and not drop_errors and not done.errors.isEmpty():
            raise FailedRows(f"{spec.name}: rows failed and errors_to names no place for them: {done.errors.first().message}")
        refused = []
        for n in graph.nodes:
            if n.kind == "sink":
                hooks.fire("on_pre_batch", n.id)
                refused.append(sinks.write(done.sinks[n.id], n.type, n.config))
                hooks.fire("on_post_batch", n.id)
        done.errors = union_errors([done.errors, *refused])
        if done.errors is not None and errors_to:
            done.errors.write.mode("append").json(errors_to)
        elif not drop_errors and (lost := union_errors(refused)) is not None and not lost.isEmpty():
            raise FailedRows(f"{spec.name}: a sink refused rows and errors_to names no place for them: {lost.first().message}")
        hooks.fire("on_checkpoint", spec.name)
        return done
    except Exception as e:
        hooks.fire("on_error", str(e))
        raise
    finally:
        for df in kept:
            df.unpersist()
        hooks.fire("on_shutdown", spec.name)


def start(spark: SparkSession, spec: Spec, context: Context, *, errors_to: str | None = None, tell=None) -> Compiled:
    """Starts a linear pipeline with a ``streaming`` schedule; the running query is in ``query`` of the result.

    ``checkpoint`` of the specification names the folder that the query continues from. Rate limits become options of
    the source, hooks fire around each batch, and rules under ``alerts`` are tested on every progress and handed to
    ``tell`` (printed by default).
    """
    from riverloom.operators.outcome import need
    from riverloom.plans.hooks import Hooks
    from riverloom.sources import sources
    from riverloom.streaming import control, runner

    if isinstance(spec, Graph):
        raise ConfigError("a stream is a source, transforms and a sink")
    if spec.sink is None:
        raise ConfigError("a stream has a sink")
    checkpoint = need(spec.options, "checkpoint", "stream")
    context.event_time = spec.options.get("event_time") or context.event_time
    context.seq = spec.options.get("seq") or context.seq
    hooks = Hooks.of(spec.hooks, context.functions)
    hooks.fire("on_init", spec.name)
    limits: dict[str, str] = {}
    for t in spec.transforms:
        if t.type == "rate_limiter":
            limits |= control.rate_options(t.config, spec.source.type)
    found = sources.read(spark, spec.source.type, {**spec.source.config, "streaming": True, "reader_options": limits}, context)
    if found.errors is not None and not errors_to:
        raise ConfigError("a stream whose source can fail needs errors_to")
    if spec.options.get("alerts"):
        rules = [control.AlertRule(**r) for r in spec.options["alerts"]]
        spark.streams.addListener(control.Alerts(rules, tell or (lambda name, found: print(f"alert {name}: {found}"))))
    steps = [t for t in spec.transforms if t.type != "rate_limiter"]
    query = runner.run_stream(
        found.ok, steps, (spec.sink.type, spec.sink.config), checkpoint, context=context, errors_to=errors_to,
        options=spec.options, hooks=hooks, source_errors=found.errors,
    )
    return Compiled(nodes={"source": found.ok}, query=query)
