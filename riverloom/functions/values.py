"""How values read as text, as numbers and as times, as Spark columns.

Pipelines compare values of different types through their text form, and read numbers out of text. These builders fix
both for every Spark type, without Python code on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The text of a null in a key.
NIL = "<nil>"
NUMBER_PREFIX = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
TIME_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})?)?$"
#: Epoch numbers beyond this are milliseconds.
MILLIS = 1_000_000_000_000


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once per row, however many expressions and filters read it.

    The optimiser moves an expression to where it is used and would parse a JSON text once per field; it does not move
    the one element of a generated array.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def is_composite(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def float_text(c: Column) -> Column:
    """The shortest text of a double, without an exponent from 1e-4 up to 1e21."""
    s = c.cast("double").cast("string")
    size = F.abs(c.cast("double"))
    strip = lambda x: F.regexp_replace(x, r"\.?0+$", "")
    plain = F.when(s.endswith(".0"), F.regexp_replace(s, r"\.0$", "")).otherwise(s)
    large = strip(s.try_cast("decimal(38,10)").cast("string"))
    small = strip(s.try_cast("decimal(38,25)").cast("string"))
    mantissa = F.regexp_replace(F.split_part(s, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.try_to_number(F.split_part(s, F.lit("E"), F.lit(2)), F.lit("S999")).cast("int")
    exponent = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (
        F.when(F.isnan(c.cast("double")), "NaN")
        .when(c.cast("double") == float("inf"), "+Inf")
        .when(c.cast("double") == float("-inf"), "-Inf")
        .when(~s.contains("E"), plain)
        .when((size >= 1) & (size < 1e21), large)
        .when((size >= 1e-4) & (size < 1), small)
        .otherwise(exponent)
    )


def text(c: Column, kind: T.DataType) -> Column:
    """The text form of a value; null for null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(c.isNotNull(), float_text(c))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        part = F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", "")
        return F.concat(whole, part, F.lit(" +0000 UTC"))
    if is_composite(kind):
        return F.to_json(c)
    return c.cast("string")


def key_text(c: Column, kind: T.DataType) -> Column:
    """The text form under which nulls are a key, too."""
    return F.coalesce(text(c, kind), F.lit(NIL))


def number(c: Column, kind: T.DataType) -> Column:
    """A value as a double: numbers as they are, text by its longest numeric beginning, else null."""
    if is_number(kind):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        return F.regexp_extract(c, NUMBER_PREFIX, 1).try_cast("double")
    return F.lit(None).cast("double")


def whole_number(c: Column, kind: T.DataType) -> Column:
    """A text that is a number as a whole as a double, else null; numbers as they are."""
    if is_number(kind):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        return F.when(c.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), c.try_cast("double"))
    return F.lit(None).cast("double")


def _epoch(n: Column) -> Column:
    """A timestamp from a count of seconds, or of milliseconds where it is large."""
    return F.when(F.abs(n) > MILLIS, F.timestamp_millis(n.cast("bigint"))).otherwise(F.timestamp_seconds(n))


def time(c: Column, kind: T.DataType) -> Column:
    """A value as a timestamp in UTC; null where it names none."""
    if isinstance(kind, T.TimestampType):
        return c
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if is_number(kind):
        return _epoch(c.cast("double"))
    if isinstance(kind, T.StringType):
        x = F.trim(c)
        n = F.when(x.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?$"), x.try_cast("double"))
        return F.when(n.isNotNull(), _epoch(n)).when(x.rlike(TIME_SHAPE), x.try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


#: Reference-time layout elements and their patterns, longest first.
_LAYOUT = [
    ("2006", "yyyy"),
    ("January", "MMMM"),
    ("Monday", "EEEE"),
    ("Jan", "MMM"),
    ("Mon", "EEE"),
    ("MST", "z"),
    ("Z07:00", "XXX"),
    ("-07:00", "xxx"),
    ("-0700", "xx"),
    (".000000", ".SSSSSS"),
    (".000", ".SSS"),
    ("01", "MM"),
    ("02", "dd"),
    ("15", "HH"),
    ("03", "hh"),
    ("04", "mm"),
    ("05", "ss"),
    ("06", "yy"),
    ("PM", "a"),
]


def layout_pattern(layout: str) -> str:
    """A Spark datetime pattern for a layout written as the reference time 2006-01-02 15:04:05."""
    out, at, plain = "", 0, ""

    def quoted(s: str) -> str:
        if not s:
            return ""
        return "'" + s.replace("'", "''") + "'" if any(ch.isalpha() or ch == "'" for ch in s) else s

    while at < len(layout):
        for a, b in _LAYOUT:
            if layout.startswith(a, at):
                out += quoted(plain) + b
                plain = ""
                at += len(a)
                break
        else:
            plain += layout[at]
            at += 1
    return out + quoted(plain)


def format_time(ts: Column, layout: str) -> Column:
    """A timestamp as unix, unix_ms, rfc3339 (also for an empty layout) or by a layout; all as text but the epochs."""
    if layout == "unix":
        return F.unix_timestamp(ts)
    if layout == "unix_ms":
        return F.unix_millis(ts)
    if layout in ("", "rfc3339", "RFC3339"):
        return rfc3339(ts)
    return F.date_format(ts, layout_pattern(layout))


def is_empty(c: Column, kind: T.DataType) -> Column:
    """Null, empty text, false, zero, or an empty array or map."""
    if isinstance(kind, T.StringType):
        bad = c == ""
    elif isinstance(kind, T.BooleanType):
        bad = ~c
    elif is_number(kind):
        bad = c == 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        bad = F.size(c) == 0
    else:
        bad = F.lit(False)
    return c.isNull() | F.coalesce(bad, F.lit(False))
