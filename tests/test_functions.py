"""Text forms, numbers, times, casts and the filter language, against plain Python models."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverloom.functions import casts, predicates
from riverloom.functions import values as V
from riverloom.functions.predicates import ConfigError

few = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def ask(spark, kind, items, build):
    """``build`` of each item of one type, computed by Spark in one job."""
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("x", kind)])
    df = spark.createDataFrame(list(enumerate(items)), schema)
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"), kind)).collect()]


def shortest(x: float) -> str:
    """A double as text without an exponent from 1e-4 up to 1e21."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0 or 1e-4 <= abs(x) < 1e21:
        from decimal import Decimal

        s = format(Decimal(repr(x)), "f")
        return re.sub(r"\.0+$", "", s) if "." in s else s
    m, _, e = repr(x).partition("e")
    if not e:
        m, _, e = format(x, ".17e").partition("e")
    m = re.sub(r"\.0+$", "", m)
    return f"{m}e{e[0] if e[0] in '+-' else '+'}{e.lstrip('+-').zfill(2)}"


def test_floats_as_text(spark):
    items = [0.0, 150.0, 1.5, -2.25, 12345678.0, 1e20, 1e21, 1.5e22, 1e-4, 1.5e-5, 0.001, 123456.789, 1e7, 9007199254740993.0, float("nan"), float("inf"), -float("inf"), 3e-7, 0.00025]
    assert ask(spark, T.DoubleType(), items, V.text) == [shortest(x) for x in items]


@few
@given(items=st.lists(st.floats(min_value=-1e15, max_value=1e15).filter(lambda x: x == 0 or abs(x) > 1e-3), min_size=1, max_size=30))
def test_any_float_as_text_reads_back(spark, items):
    got = ask(spark, T.DoubleType(), items, V.text)
    assert [float(t) for t in got] == items and not any("e" in t for t in got)


def test_other_values_as_text(spark):
    assert ask(spark, T.BooleanType(), [True, False, None], V.text) == ["true", "false", None]
    assert ask(spark, T.LongType(), [1, None], V.key_text) == ["1", "<nil>"]
    assert ask(spark, T.ArrayType(T.StringType()), [["a"], None], V.text) == ['["a"]', None]


def test_numbers_in_text(spark):
    items = ["12abc", " 42 ", "1.9", "x", "", "-3e2z", ".5", "1e", None, "+7"]
    assert ask(spark, T.StringType(), items, V.number) == [12.0, 42.0, 1.9, None, None, -300.0, 0.5, 1.0, None, 7.0]


def test_times(spark):
    items = ["2024-03-01", "2024-03-01 10:20:30", "2024-03-01T10:20:30Z", "2024-03-01T10:20:30.5+02:00", "1709288430", "1709288430000", "soon", "", None, "2024-13-01"]
    got = ask(spark, T.StringType(), items, lambda c, k: F.date_format(V.time(c, k), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2024-03-01 00:00:00", "2024-03-01 10:20:30", "2024-03-01 10:20:30", "2024-03-01 08:20:30", "2024-03-01 10:20:30", "2024-03-01 10:20:30", None, None, None, None]
    assert ask(spark, T.LongType(), [0, 1709288430, 1709288430000], lambda c, k: V.rfc3339(V.time(c, k))) == ["1970-01-01T00:00:00Z", "2024-03-01T10:20:30Z", "2024-03-01T10:20:30Z"]


@pytest.mark.parametrize(
    "layout,shown",
    [("2006-01-02", "2024-03-01"), ("02/01/06 15h04", "01/03/24 10h20"), ("Jan 2, 2006", "Mar 2, 2024"), ("2006-01-02T15:04:05.000", "2024-03-01T10:20:30.250"), ("at 15:04", "at 10:20")],
)
def test_layouts(spark, layout, shown):
    assert ask(spark, T.StringType(), ["2024-03-01 10:20:30.25"], lambda c, k: V.format_time(V.time(c, k), layout)) == [shown]


def test_casts(spark):
    s = T.StringType()
    assert ask(spark, s, ["1.9", "-1.9", " 7 ", "x", "", None, "1e3", "99999999999999999999"], casts.to_int) == [1, -1, 7, None, None, None, 1000, None]
    assert ask(spark, T.DoubleType(), [1.9, -1.9, float("nan"), None], casts.to_int) == [1, -1, None, None]
    assert ask(spark, T.BooleanType(), [True, False], casts.to_int) == [1, 0]
    assert ask(spark, s, ["12abc", "abc", None], casts.to_float) == [12.0, None, None]
    assert ask(spark, s, ["YES", " on ", "t", "0", "", "maybe", None], casts.to_bool) == [True, True, True, False, False, None, None]
    assert ask(spark, T.LongType(), [2, 0], casts.to_bool) == [True, False]
    assert ask(spark, s, ["a, b", '["x", "y"]', "", "one", None], casts.to_array) == [["a", "b"], ["x", "y"], [], ["one"], None]
    assert ask(spark, T.LongType(), [5, None], casts.to_array) == [["5"], None]
    assert ask(spark, s, ['say "hi"', None], casts.to_json) == ['"say \\"hi\\""', None]
    assert ask(spark, T.LongType(), [5], casts.to_json) == ["5"]
    assert ask(spark, s, ["2024-03-01 10:20:30"], lambda c, k: V.rfc3339(casts.to_date(c, k))) == ["2024-03-01T00:00:00Z"]
    with pytest.raises(ValueError):
        casts.cast(F.col("x"), s, "to_nothing")


# ------------------------------------------------------------- filters

ROWS = [{"a": a, "s": s} for a in (None, 0.0, 1.0, 2.5) for s in (None, "", "x", "12abc")]


def model(node, row):
    """A filter tree as Python sees it."""
    kind = node[0]
    if kind == "not":
        return not model(node[1], row)
    if kind in ("and", "or"):
        a, b = model(node[1], row), model(node[2], row)
        return a and b if kind == "and" else a or b
    _, name, op, value = node
    v = row[name]
    if op == "nil":
        return v is None
    if op == "some":
        return v is not None
    if v is None:
        return False
    if isinstance(value, str):
        v = shortest(v) if isinstance(v, float) else v
    elif isinstance(v, str):
        m = re.match(V.NUMBER_PREFIX, v)
        if not m:
            return False
        v = float(m.group(1))
    return {"==": v == value, "!=": v != value, ">": v > value, "<": v < value, ">=": v >= value, "<=": v <= value}[op]


def shown(node):
    if node[0] == "not":
        return f"!({shown(node[1])})"
    if node[0] in ("and", "or"):
        return f"({shown(node[1])} {node[0] if hash(node[1]) % 2 else {'and': '&&', 'or': '||'}[node[0]]} {shown(node[2])})"
    _, name, op, value = node
    if op == "nil":
        return f"{name} nil"
    if op == "some":
        return name
    return f"{name} {op} " + (f"'{value}'" if isinstance(value, str) else str(value))


atoms = st.one_of(
    st.tuples(st.just("cmp"), st.sampled_from(["a", "s"]), st.sampled_from(["==", "!=", ">", "<", ">=", "<="]), st.sampled_from([0, 1, 2.5, 12, -1, "", "x", "1", "2.5"])),
    st.tuples(st.just("cmp"), st.sampled_from(["a", "s"]), st.sampled_from(["nil", "some"]), st.none()),
)
trees = st.recursive(atoms, lambda t: st.one_of(st.tuples(st.just("not"), t), st.tuples(st.sampled_from(["and", "or"]), t, t)), max_leaves=6)


@few
@given(found=st.lists(trees, min_size=1, max_size=12))
def test_filters_are_two_valued(spark, found):
    df = spark.createDataFrame([(i, r["a"], r["s"]) for i, r in enumerate(ROWS)], "i int, a double, s string")
    columns = [predicates.compile_filter(shown(t), df.schema).keep.alias(f"t{k}") for k, t in enumerate(found)]
    got = df.select("i", *columns).orderBy("i").collect()
    for i, row in enumerate(ROWS):
        assert [got[i][f"t{k}"] for k in range(len(found))] == [model(t, row) for t in found], list(map(shown, found))


def test_filters_that_are_refused():
    schema = T.StructType([T.StructField("a", T.LongType())])
    for bad in ("a >", "a > b", "(a > 1", "a > 1 2", "and", "a ? 1", "a > 'x", "a is null"):
        with pytest.raises(ConfigError):
            predicates.compile_filter(bad, schema)
    assert predicates.compile_filter("  ", schema).errors == []


def test_patterns_that_need_backtracking_are_refused():
    for bad in (r"(?=a)", r"(a)\1", r"a*+", r"(?<!x)y", "("):
        with pytest.raises(ConfigError):
            predicates.check_regex(bad)
    assert predicates.check_regex(r"a\\1|b") == r"a\\1|b"
