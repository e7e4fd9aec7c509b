"""What an operator returns, the registry of operators, and helpers for failed rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverloom.functions.predicates import ConfigError

ERROR_SCHEMA = "node string, error_class string, message string, record string"
META = "_meta"
BEFORE = "_before"


@dataclass
class Context:
    """What a pipeline hands to its operators: named tables, user functions, the event-time and order columns.

    A table is a DataFrame, or a function that loads one; see ``joins.Snapshots``.
    """

    tables: dict[str, Any] = field(default_factory=dict)
    functions: dict[str, Callable] = field(default_factory=dict)
    node: str = ""
    event_time: str | None = None
    seq: str | None = None
    streaming: bool = False
    now: Column | None = None
    snapshots: Any = None

    def __post_init__(self):
        if self.snapshots is None:
            from riverloom.operators.joins import Snapshots

            self.snapshots = Snapshots()

    def time_now(self) -> Column:
        return self.now if self.now is not None else F.current_timestamp()


@dataclass
class Outcome:
    """Rows that go on, and rows that failed with the reason (schema ERROR_SCHEMA), if any can.

    ``shared`` are the rows that both are taken from, where making them runs user code or calls a service.
    """

    ok: DataFrame
    errors: DataFrame | None = None
    shared: DataFrame | None = None


Builder = Callable[[DataFrame, dict[str, Any], Context], Outcome]
OPERATORS: dict[str, Builder] = {}


def operator(*names: str):
    def add(f: Builder) -> Builder:
        for n in names:
            OPERATORS[n] = f
        return f

    return add


def apply(df: DataFrame, name: str, config: dict[str, Any] | None = None, context: Context | None = None) -> Outcome:
    """Compile one operator over ``df``."""
    import riverloom.plans.compile  # noqa: F401  registers the operators

    build = OPERATORS.get(name)
    if build is None and name.startswith("plugin_"):
        build = OPERATORS["plugin"]
        config = {"name": name.removeprefix("plugin_"), **(config or {})}
    if build is None:
        raise ConfigError(f"no operator {name!r}")
    context = context or Context()
    if not context.node:
        context = Context(**{**context.__dict__, "node": name})
    out = build(df, dict(config or {}), context)
    return out if isinstance(out, Outcome) else Outcome(out)


def record_json(df: DataFrame, leave: tuple[str, ...] = ()) -> Column:
    names = [c for c in df.columns if c not in leave]
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])) if names else F.lit("{}")


def failed(df: DataFrame, node: str, error_class: str, message: Column | str, leave: tuple[str, ...] = ()) -> DataFrame:
    """Rows as entries of the error output."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.select(
        F.lit(node).alias("node"), F.lit(error_class).alias("error_class"), text.alias("message"), record_json(df, leave).alias("record")
    )


def split(df: DataFrame, message: Column, context: Context, error_class: str = "data", leave: tuple[str, ...] = ()) -> Outcome:
    """Rows without a message go on, rows with one fail. Columns in ``leave`` are helpers and go nowhere."""
    marked = df.withColumn("__error", message)
    ok = marked.where(F.col("__error").isNull()).drop("__error", *leave)
    bad = marked.where(F.col("__error").isNotNull())
    return Outcome(ok, failed(bad, context.node, error_class, F.col("__error"), ("__error", *leave)))


def union_errors(parts: list[DataFrame | None]) -> DataFrame | None:
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out.unionByName(p)
    return out


def need(config: dict, name: str, op: str):
    if config.get(name) in (None, "", [], {}):
        raise ConfigError(f"{op}: {name} is required")
    return config[name]


def whole(config: dict, name: str, default: int | None = None) -> int | None:
    """A whole number that a configuration holds as an int or a float."""
    v = config.get(name, default)
    if v is None:
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)) or float(v) != int(v):
        raise ConfigError(f"{name}: {v!r} is not a whole number")
    return int(v)


#: The classes that an error can have, and words of a message that tell a class, tried in this order.
ERROR_CLASSES = ("unknown", "transient", "data", "schema", "auth", "config", "programming")
ERROR_WORDS = {
    "transient": [
        "connection refused",
        "connection reset",
        "i/o timeout",
        "timeout",
        "temporarily",
        "too many connections",
        "deadlock",
        "try again",
        "broken pipe",
        "no scannode backend available",
        "not alive",
        "in black list",
    ],
    "auth": ["access denied", "permission denied", "unauthorized", "forbidden", "authentication", "invalid credentials"],
    "schema": [
        "unknown column",
        "missing column",
        "no such column",
        "doesn't exist",
        "does not exist",
        "unknown table",
        "schema",
        "type mismatch",
        "cannot convert",
        "unsupported conversion",
    ],
    "config": ["invalid config", "is required", "unsupported", "unknown source", "unknown sink", "unknown transform"],
    "data": [
        "duplicate",
        "constraint",
        "invalid input",
        "parse",
        "decode",
        "malformed",
        "truncated",
        "out of range",
        "data too long",
        "incorrect datetime value",
        "incorrect date value",
        "incorrect integer value",
    ],
    "programming": ["panic", "nil pointer", "index out of range"],
}


def classify(error: BaseException | str) -> str:
    """The class of an error, by its type or by words of its message."""
    if isinstance(error, ConfigError):
        return "config"
    if isinstance(error, (TimeoutError, ConnectionError)):
        return "transient"
    if isinstance(error, PermissionError):
        return "auth"
    if isinstance(error, (TypeError, AttributeError, KeyError, IndexError, AssertionError)):
        return "programming"
    text = str(error).lower()
    return next((k for k, words in ERROR_WORDS.items() if any(w in text for w in words)), "unknown")


def retryable(error: BaseException | str) -> bool:
    return classify(error) in ("transient", "unknown")
