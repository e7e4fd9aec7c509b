"""Casts between payload types; a value that cannot be cast is null and counts as failed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverloom.functions import values as V

#: Texts that are true and false.
TRUE, FALSE = ["1", "t", "true", "yes", "y", "on"], ["0", "f", "false", "no", "n", "off", ""]

ALIASES = {
    "string": "to_string",
    "str": "to_string",
    "int": "to_int",
    "integer": "to_int",
    "int64": "to_int",
    "float": "to_float",
    "double": "to_float",
    "float64": "to_float",
    "number": "to_float",
    "bool": "to_bool",
    "boolean": "to_bool",
    "timestamp": "to_timestamp",
    "datetime": "to_timestamp",
    "date": "to_date",
    "json": "to_json",
    "array": "to_array",
}


def to_string(c: Column, kind: T.DataType) -> Column:
    return V.text(c, kind)


def _cut(n: Column) -> Column:
    """A double cut off towards zero; null beyond 64 bits."""
    return F.when(F.abs(n) < 2.0**63, n.cast("bigint"))


def to_int(c: Column, kind: T.DataType) -> Column:
    """Numbers cut off towards zero, booleans as 1 and 0, text as an integer or else as a cut-off number."""
    if isinstance(kind, T.BooleanType):
        return c.cast("bigint")
    if V.is_integer(kind):
        return c.cast("bigint")
    if V.is_number(kind):
        return _cut(c.cast("double"))
    if isinstance(kind, T.StringType):
        x = F.trim(c)
        whole = F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("bigint"))
        return F.coalesce(whole, _cut(V.whole_number(x, kind)))
    return F.lit(None).cast("bigint")


def to_float(c: Column, kind: T.DataType) -> Column:
    """Numbers, booleans as 1 and 0, text by its numeric beginning."""
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    return V.number(c, kind)


def to_bool(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return c
    if V.is_number(kind):
        return c != 0
    if isinstance(kind, T.StringType):
        x = F.lower(F.trim(c))
        return F.when(x.isin(TRUE), True).when(x.isin(FALSE), False)
    return F.lit(None).cast("boolean")


def to_timestamp(c: Column, kind: T.DataType) -> Column:
    return V.time(c, kind)


def to_date(c: Column, kind: T.DataType) -> Column:
    """Midnight in UTC of the value's day, as a timestamp."""
    return F.date_trunc("DAY", V.time(c, kind))


def to_json(c: Column, kind: T.DataType) -> Column:
    if V.is_composite(kind):
        return F.to_json(c)
    if isinstance(kind, T.StringType):
        quoted = F.to_json(F.array(c))
        return F.when(c.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.concat(F.lit('"'), V.rfc3339(c.cast("timestamp")), F.lit('"'))
    return V.text(c, kind)


def to_array(c: Column, kind: T.DataType) -> Column:
    """Arrays as they are; text as a JSON array where it begins with a bracket, else split at commas; others alone."""
    if isinstance(kind, T.ArrayType):
        return c
    if isinstance(kind, T.StringType):
        x = F.trim(c)
        parts = F.transform(F.split(x, ","), lambda part: F.trim(part))
        empty = F.array().cast("array<string>")
        return F.when(x == "", empty).when(x.startswith("["), F.from_json(x, "array<string>")).when(c.isNotNull(), parts)
    return F.when(c.isNotNull(), F.array(V.text(c, kind)))


TARGETS = {f.__name__: f for f in (to_string, to_int, to_float, to_bool, to_timestamp, to_date, to_json, to_array)}


def cast(c: Column, kind: T.DataType, target: str) -> Column:
    name = ALIASES.get(target, target)
    if name not in TARGETS:
        raise ValueError(f"no cast to {target}")
    return TARGETS[name](c, kind)


#: What type_convert accepts, and the cast that it stands for.
CONVERSIONS = {
    **dict.fromkeys(["int", "int64", "integer"], "to_int"),
    **dict.fromkeys(["float", "float64", "double", "number"], "to_float"),
    **dict.fromkeys(["bool", "boolean"], "to_bool"),
    **dict.fromkeys(["string", "str"], "to_string"),
    **dict.fromkeys(["datetime", "timestamp"], "to_timestamp"),
}
