"""User code and SQL models in a pipeline."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverloom.functions.predicates import ConfigError
from riverloom.operators.joins import loaded, run_sql
from riverloom.operators.outcome import Context, Outcome, need, operator
from riverloom.operators.project import col


def _function(config: dict, context: Context, op: str) -> Callable[[dict], Any]:
    f = config.get("function")
    f = context.functions.get(f) if isinstance(f, str) else f
    if not callable(f):
        raise ConfigError(f"{op}: no function {config.get('function')!r}")
    return f


def plain(value: Any) -> Any:
    """A value of a pandas row as the one Python would hold."""
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    return value.item() if hasattr(value, "item") and not hasattr(value, "__len__") else value


def call_rows(df: DataFrame, f: Callable[[dict], Any], schema: str, context: Context, on_error: str) -> Outcome:
    """Each row through ``f``: None or False drops it, a mapping is a row, a list is several rows.

    Rows pass in Arrow batches; a row whose function raises fails alone.
    """
    names = T._parse_datatype_string(schema).names
    before = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[dict] = []
            for row in pdf.astype(object).to_dict("records"):
                row = {k: plain(v) for k, v in row.items()}
                try:
                    got = f(dict(row))
                except Exception as e:
                    out.append({"__failed": f"{type(e).__name__}: {e}", "__record": _json(row)})
                    continue
                rows = got if isinstance(got, list) else [] if got is None or got is False else [row if got is True else got]
                out += [{**{n: x.get(n) for n in names}, "__failed": None, "__record": None} for x in rows]
            yield pd.DataFrame(out, columns=[*names, "__failed", "__record"], dtype=object)

    found = df.select(*[col(c) for c in before]).mapInPandas(run, f"{schema}, __failed string, __record string")
    ok = found.where(F.col("__failed").isNull()).drop("__failed", "__record")
    if on_error == "drop":
        return Outcome(ok)
    if on_error == "error":
        checked = found.where(F.when(F.col("__failed").isNotNull(), F.raise_error(F.col("__failed"))).isNull())
        return Outcome(checked.drop("__failed", "__record"))
    bad = found.where(F.col("__failed").isNotNull()).select(
        F.lit(context.node).alias("node"), F.lit("data").alias("error_class"), F.col("__failed").alias("message"), F.col("__record").alias("record")
    )
    return Outcome(ok, bad, found)


def _json(row: dict) -> str:
    import json

    return json.dumps(row, default=str)


@operator("python", "lua", "ts", "js", "javascript")
def python(df: DataFrame, config: dict, context: Context) -> Outcome:
    """A Python function over rows; the names of other script languages stand for it.

    Scripts in those languages are not run: a configuration with script text is refused.
    """
    if config.get("script"):
        raise ConfigError("scripts are Python functions here; register one and name it in `function`")
    schema = config.get("schema") or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return call_rows(df, _function(config, context, "python"), schema, context, config.get("on_error", "dlq"))


@operator("flat_map", "udtf")
def flat_map(df: DataFrame, config: dict, context: Context) -> Outcome:
    """One row to many: by exploding an array column (declarative), or by a Python function."""
    if config.get("explode"):
        name = config["explode"]
        if name not in df.columns:
            raise ConfigError(f"flat_map: no column {name}")
        kind = df.schema[name].dataType
        if not isinstance(kind, (T.ArrayType, T.MapType)):
            raise ConfigError(f"flat_map: {name} is no array")
        rest = [col(c) for c in df.columns if c != name]
        make = F.explode_outer if config.get("keep_empty") else F.explode
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out = df.select(*rest, make(col(name)).alias("__x"))
            taken = [c for c in df.columns if c != name]
            fields = [F.col(f"__x.`{n}`").alias(n) for n in kind.elementType.names]
            return Outcome(out.select(*[col(c) for c in taken if c not in kind.elementType.names], *fields))
        return Outcome(df.select(*rest, make(col(name)).alias(config.get("as", name))))
    return call_rows(df, _function(config, context, "flat_map"), need(config, "schema", "flat_map"), context, config.get("on_error", "dlq"))


@operator("sql", "dbt")
def sql(df: DataFrame, config: dict, context: Context) -> DataFrame:
    """A SQL model over the rows (as ``source_table``, by default ``input``) and the pipeline's tables.

    Columns that begin with an underscore are not part of the model's input.
    """
    model = need(config, "model" if config.get("model") else "query", "sql")
    name = config.get("source_table", "input")
    rows = df.select(*[col(c) for c in df.columns if not c.startswith("_")])
    return run_sql(model, {name: rows, **loaded(context, config)})


PLUGINS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}
KINDS = ("transform", "source", "sink")


def plugin(name: str, abi: int = 1, kind: str = "transform"):
    """Registers a function as ``plugin_<name>``.

    A transform takes a DataFrame and a configuration and returns a DataFrame, a source a session and a configuration,
    a sink a DataFrame and a configuration; a source may return an ``Outcome``, a sink the rows that it refused.
    """
    if abi != 1:
        raise ConfigError(f"plugin {name}: interface {abi} is not known")
    if kind not in KINDS:
        raise ConfigError(f"plugin {name}: no kind {kind!r}")

    def add(f):
        register(name, f, kind)
        return f

    return add


def register(name: str, f: Callable, kind: str) -> None:
    from riverloom.sources import sinks, sources

    if kind == "transform":
        PLUGINS[name] = f
    elif kind == "source":
        sources.SOURCES[f"plugin_{name}"] = lambda spark, config, context: f(spark, config)
    else:
        sinks.SINKS[f"plugin_{name}"] = f


def installed(name: str, kind: str) -> bool:
    """Registers an installed plugin of that name, from the packages' entry points ``riverloom.<kind>s``, if there is one."""
    from importlib.metadata import entry_points

    groups = [f"riverloom.{kind}s", *(["riverloom.plugins"] if kind == "transform" else [])]
    found = [e for g in groups for e in entry_points(group=g) if e.name == name]
    if found:
        register(name, found[0].load(), kind)
    return bool(found)


@operator("plugin")
def run_plugin(df: DataFrame, config: dict, context: Context) -> DataFrame:
    name = config.pop("name", None)
    if name not in PLUGINS and not installed(name, "transform"):
        raise ConfigError(f"no plugin {name!r}")
    return PLUGINS[name](df, config)
