"""Specifications: YAML or dictionaries, environment variables, defaults, and validation that collects all faults."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from riverloom.functions.predicates import ConfigError
from riverloom.operators.outcome import OPERATORS

_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")

#: The names that sources and sinks can have, and what a specification leaves out.
SOURCES = ("file", "mysql_batch", "mysql_cdc", "mysql_snapshot_cdc", "postgres_cdc", "kafka", "http", "rest_source", "salesforce", "github", "hubspot", "stripe", "notion", "redis", "feishu_sheet", "demo", "table", "jdbc")
SINKS = ("file_sink", "s3", "mysql", "postgres", "postgresql", "jdbc", "sqlite", "clickhouse", "doris", "elasticsearch", "es", "kafka", "redis", "maxcompute", "odps", "table", "memory")
DEFAULTS = {"batch_size": 1000, "flush_interval_ms": 1000, "checkpoint_interval_sec": 30, "backpressure_buffer": 100}
SCHEDULES = ("once", "streaming", "cron", "periodic", "dependency")
CDC_SOURCES = ("mysql_cdc", "mysql_snapshot_cdc", "postgres_cdc")


def expand(text: str, env: dict[str, str] | None = None) -> str:
    """``${NAME}`` and ``${NAME:-default}`` from the environment; an empty variable takes the default."""
    env = dict(os.environ) if env is None else env
    return _VARIABLE.sub(lambda m: env.get(m.group(1)) or (m.group(2) or ""), text)


@dataclass
class Step:
    type: str
    config: dict[str, Any] = field(default_factory=dict)


@dataclass
class Spec:
    """A linear pipeline: source, transforms, sink."""

    name: str
    source: Step
    transforms: list[Step] = field(default_factory=list)
    sink: Step | None = None
    options: dict[str, Any] = field(default_factory=dict)
    hooks: dict[str, Any] = field(default_factory=dict)


@dataclass
class Edge:
    from_: str
    to: str
    condition: dict[str, Any] | None = None


@dataclass
class Node:
    id: str
    kind: str
    type: str = ""
    config: dict[str, Any] = field(default_factory=dict)


@dataclass
class Graph:
    """A pipeline as nodes and conditional edges."""

    name: str
    nodes: list[Node]
    edges: list[Edge]
    options: dict[str, Any] = field(default_factory=dict)
    hooks: dict[str, Any] = field(default_factory=dict)


NODE_KINDS = ("source", "transform", "sink", "fanout", "router", "tap", "rate_limiter", "enricher", "lookup", "merge")


def _step(x: Any) -> Step:
    x = {"type": x} if isinstance(x, str) else dict(x or {})
    config = x.get("config") or {k: v for k, v in x.items() if k not in ("type", "name", "plugin")}
    return Step(x.get("type") or x.get("plugin") or x.get("name") or "", config)


def _processors(given: Any) -> list[Step]:
    """Steps before the transforms, as a list or as a mapping of names to configurations."""
    if isinstance(given, dict):
        return [Step(k, dict(v or {})) for k, v in given.items()]
    return [_step(x) for x in given or []]


def _before_sources(nodes: list[Node], edges: list[Edge], step: Step, i: int) -> tuple[list[Node], list[Edge]]:
    """A processor behind each source of a graph, after the processors before it."""
    out, moved = list(nodes), list(edges)
    for n in [n for n in nodes if n.kind == "source" or n.id.endswith(f".p{i - 1}")]:
        if n.kind == "source" and i:
            continue
        new = Node(f"{n.id.removesuffix(f'.p{i - 1}')}.p{i}", "transform", step.type, step.config)
        moved = [Edge(new.id, e.to, e.condition) if e.from_ == n.id else e for e in moved] + [Edge(n.id, new.id)]
        out.append(new)
    return out, moved


def parse(data: str | dict | Path, env: dict[str, str] | None = None) -> Spec | Graph:
    """A specification from YAML text, a file or a dictionary; ``nodes`` make it a graph."""
    if isinstance(data, Path):
        data = data.read_text()
    if isinstance(data, str):
        import yaml

        data = yaml.safe_load(expand(data, env))
    if not isinstance(data, dict):
        raise ConfigError("a specification is a mapping")
    body = data.get("pipeline", data) if isinstance(data.get("pipeline", data), dict) else data
    name = body.get("name") or data.get("name") or ""
    options = DEFAULTS | {k: body[k] for k in (*DEFAULTS, "parallelism", "schedule", "event_time", "seq", "allow_unsafe", "state", "alerts", "checkpoint", "errors_to") if k in body}
    graph = body.get("dag", body)
    if "nodes" in graph:
        nodes = [
            Node(n["id"], n.get("kind") or n.get("type") or "transform", n.get("plugin") or n.get("operator") or (n.get("type") if n.get("kind") else "") or "", n.get("config") or {})
            for n in graph["nodes"]
        ]
        edges = [Edge(e.get("from", ""), e.get("to", ""), e.get("condition")) for e in graph.get("edges") or []]
        for i, step in enumerate(_processors(body.get("processors"))):
            nodes, edges = _before_sources(nodes, edges, step, i)
        return Graph(name, nodes, edges, options, body.get("hooks") or {})
    if "source" not in body:
        raise ConfigError("a specification has a source or nodes")
    steps = _processors(body.get("processors")) + [_step(t) for t in body.get("transforms") or []]
    spec = Spec(name, _step(body["source"]), steps, _step(body["sink"]) if body.get("sink") else None, options, body.get("hooks") or {})
    return spec


def known_operator(name: str) -> bool:
    return name in OPERATORS or name.startswith("plugin_")


def faults(spec: Spec | Graph) -> list[str]:
    """Everything that is wrong with a specification."""
    import riverloom.plans.compile  # noqa: F401  registers the operators

    out: list[str] = []
    if not spec.name:
        out.append("a name is required")
    for k in DEFAULTS:
        if not isinstance(spec.options.get(k), (int, float)) or spec.options[k] <= 0:
            out.append(f"{k} is a positive number")
    kind = (spec.options.get("schedule") or {}).get("type", "once") if isinstance(spec.options.get("schedule"), dict) else spec.options.get("schedule") or "once"
    if kind not in SCHEDULES:
        out.append(f"no schedule {kind!r}")
    if isinstance(spec, Graph):
        return out + graph_faults(spec)
    if spec.source.type not in SOURCES and not spec.source.type.startswith("plugin_"):
        out.append(f"no source {spec.source.type!r}")
    if spec.sink and spec.sink.type not in SINKS and not spec.sink.type.startswith("plugin_"):
        out.append(f"no sink {spec.sink.type!r}")
    for i, t in enumerate(spec.transforms):
        if not known_operator(t.type):
            out.append(f"transform {i}: no operator {t.type!r}")
        if t.type == "window" and t.config.get("window_type", t.config.get("type", "tumbling")) != "tumbling":
            out.append(f"transform {i}: only tumbling windows are supported")
        if t.config.get("keyed_state") or t.config.get("timers"):
            out.append(f"transform {i}: keyed state and timers are not supported")
    if kind == "streaming" and spec.source.type in ("mysql_batch", "feishu_sheet", "jdbc"):
        out.append(f"{spec.source.type} is not a streaming source")
    if kind in ("cron", "periodic") and spec.source.type in CDC_SOURCES:
        out.append(f"{spec.source.type} is a streaming source")
    return out


def graph_faults(graph: Graph) -> list[str]:
    out: list[str] = []
    ids = [n.id for n in graph.nodes]
    out += [f"node {i!r} appears twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    by = {n.id: n for n in graph.nodes}
    for n in graph.nodes:
        if n.kind not in NODE_KINDS:
            out.append(f"node {n.id}: no kind {n.kind!r}")
        if n.kind == "transform" and not known_operator(n.type):
            out.append(f"node {n.id}: no operator {n.type!r}")
    for e in graph.edges:
        for end in (e.from_, e.to):
            if end not in by:
                out.append(f"edge {e.from_} -> {e.to}: no node {end!r}")
        if e.from_ in by and by[e.from_].kind == "sink":
            out.append(f"edge {e.from_} -> {e.to}: nothing leaves a sink")
        if e.to in by and by[e.to].kind == "source":
            out.append(f"edge {e.from_} -> {e.to}: nothing enters a source")
    if not any(n.kind == "source" for n in graph.nodes):
        out.append("a graph has a source")
    if not any(n.kind == "sink" for n in graph.nodes):
        out.append("a graph has a sink")
    ends = {e.from_ for e in graph.edges} | {e.to for e in graph.edges}
    out += [f"node {n.id} has no edge" for n in graph.nodes if len(graph.nodes) > 1 and n.id not in ends]
    if topological(graph) is None:
        out.append("the graph has a cycle")
    return out


def topological(graph: Graph) -> list[str] | None:
    """Node ids so that every edge goes forward, in the order of the specification where it leaves a choice."""
    ids = [n.id for n in graph.nodes]
    waits = {i: 0 for i in ids}
    for e in graph.edges:
        if e.to in waits and e.from_ in waits:
            waits[e.to] += 1
    out: list[str] = []
    ready = [i for i in ids if not waits[i]]
    while ready:
        i = ready.pop(0)
        out.append(i)
        for e in graph.edges:
            if e.from_ == i and e.to in waits:
                waits[e.to] -= 1
                if not waits[e.to]:
                    ready.append(e.to)
    return out if len(out) == len(set(ids)) else None


def validate(spec: Spec | Graph) -> None:
    if found := faults(spec):
        raise ConfigError("; ".join(found))


def to_graph(spec: Spec) -> Graph:
    """A linear pipeline as a graph of one path."""
    nodes = [Node("source", "source", spec.source.type, spec.source.config)]
    nodes += [Node(f"t{i}", "transform", t.type, t.config) for i, t in enumerate(spec.transforms)]
    if spec.sink:
        nodes.append(Node("sink", "sink", spec.sink.type, spec.sink.config))
    ids = [n.id for n in nodes]
    return Graph(spec.name, nodes, [Edge(a, b) for a, b in zip(ids[:-1], ids[1:], strict=True)], spec.options, spec.hooks)
