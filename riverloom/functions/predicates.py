"""The filter language and other row predicates, compiled to columns with two-valued logic.

::

    or    := and (('||' | or) and)*
    and   := not (('&&' | and) not)*
    not   := ('!' | not) not | atom
    atom  := '(' or ')' | field | field ('nil' | 'null') | field op literal
    op    := '==' | '=' | '!=' | '>' | '<' | '>=' | '<='

A literal is a number or a quoted text. A comparison with a null is false, and ``not`` turns false into true, so every
comparison is closed with a default before it is combined.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverloom.functions import values as V


class ConfigError(ValueError):
    """A pipeline that cannot be compiled."""


_TOKEN = re.compile(
    r"\s*(?:(?P<num>-?[0-9][0-9.]*)|(?P<str>'[^']*'|\"[^\"]*\")|(?P<op>==|!=|>=|<=|>|<|=)|(?P<and>&&)|(?P<or>\|\|)"
    r"|(?P<not>!)|(?P<open>\()|(?P<close>\))|(?P<id>[A-Za-z_][A-Za-z0-9_.\-]*))"
)
_WORDS = {"and": "and", "AND": "and", "or": "or", "OR": "or", "not": "not", "NOT": "not"}
_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b,
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}


def tokens(expression: str) -> list[tuple[str, str]]:
    out, at = [], 0
    end = len(expression.rstrip())
    while at < end:
        m = _TOKEN.match(expression, at)
        if not m:
            raise ConfigError(f"filter: cannot read {expression[at : at + 20]!r}")
        kind = m.lastgroup or ""
        word = m.group(kind)
        out.append((_WORDS.get(word, kind) if kind == "id" else kind, word))
        at = m.end()
    return out


@dataclass
class Predicate:
    """A compiled filter: ``keep`` is never null; ``errors`` are conditions under which a strict filter fails a row."""

    keep: Column
    errors: list[tuple[Column, str]] = field(default_factory=list)


def closed(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


class _Parser:
    def __init__(self, expression: str, schema: T.StructType, strict: bool):
        self.todo = tokens(expression)
        self.at = 0
        self.schema = {f.name: f.dataType for f in schema.fields}
        self.strict = strict
        self.errors: list[tuple[Column, str]] = []

    def peek(self) -> str:
        return self.todo[self.at][0] if self.at < len(self.todo) else "end"

    def take(self, kind: str | None = None) -> str:
        if self.at >= len(self.todo) or kind and self.todo[self.at][0] != kind:
            found = self.todo[self.at][1] if self.at < len(self.todo) else "the end"
            raise ConfigError(f"filter: expected {kind or 'more'}, found {found}")
        self.at += 1
        return self.todo[self.at - 1][1]

    def parse(self) -> Column:
        out = self.either()
        if self.peek() != "end":
            raise ConfigError(f"filter: {self.todo[self.at][1]!r} is left over")
        return out

    def either(self) -> Column:
        out = self.both()
        while self.peek() == "or":
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.negated()
        while self.peek() == "and":
            self.take()
            out = out & self.negated()
        return out

    def negated(self) -> Column:
        if self.peek() == "not":
            self.take()
            return ~self.negated()
        return self.atom()

    def atom(self) -> Column:
        if self.peek() == "open":
            self.take()
            out = self.either()
            self.take("close")
            return out
        name = self.take("id")
        kind = self.schema.get(name)
        value = F.col(f"`{name}`") if kind is not None else F.lit(None).cast("string")
        kind = kind or T.StringType()
        if self.peek() == "id":
            word = self.take()
            if word.lower() not in ("nil", "null"):
                raise ConfigError(f"filter: unexpected {word!r} after {name}")
            return value.isNull()
        if self.peek() != "op":
            return value.isNotNull()
        op = _OPS[self.take()]
        if self.peek() == "num":
            literal = float(self.take())
            n = V.number(value, kind)
            if self.strict:
                self.errors.append((value.isNotNull() & n.isNull(), f"{name} is not a number"))
            return closed(op(n, F.lit(literal)))
        return closed(op(V.text(value, kind), F.lit(self.take("str")[1:-1])))


def compile_filter(expression: str, schema: T.StructType, strict: bool = False) -> Predicate:
    """A filter expression as a predicate over columns; an empty one keeps everything."""
    if not expression.strip():
        return Predicate(F.lit(True))
    parser = _Parser(expression, schema, strict)
    keep = parser.parse()
    return Predicate(keep, parser.errors)


def edge_condition(condition: dict, schema: T.StructType) -> Column:
    """One of eq, ne, gt, lt, ge, le, contains, regex on one field; a missing or null field is false for all of them.

    Order compares numbers where field and value both are numbers and texts otherwise; text is never read as a number.
    """
    name, op, value = condition["field"], condition.get("op", "eq"), condition.get("value")
    root, _, rest = name.partition(".")
    kinds = {f.name: f.dataType for f in schema.fields}
    if name in kinds:
        c, kind = F.col(f"`{name}`"), kinds[name]
    elif root in kinds and rest and isinstance(kinds[root], T.StructType) and rest in kinds[root].names:
        c, kind = F.col(f"`{root}`.`{rest}`"), kinds[root][rest].dataType
    else:
        return F.lit(False)
    shown = F.lit(value_text(value))
    own = V.text(c, kind)
    if op == "eq":
        out = own == shown
    elif op == "ne":
        out = own != shown
    elif op in ("gt", "lt", "ge", "le"):
        compare = _OPS[{"gt": ">", "lt": "<", "ge": ">=", "le": "<="}[op]]
        both = V.is_number(kind) and isinstance(value, (int, float)) and not isinstance(value, bool)
        out = compare(c.cast("double"), F.lit(float(value))) if both else compare(own, shown)
    elif op == "contains":
        out = own.contains(shown)
    elif op == "regex":
        check_regex(str(value))
        out = own.rlike(str(value))
    else:
        raise ConfigError(f"edge condition: no operator {op}")
    return closed(out)


def value_text(value) -> str:
    """The text form of a value that a configuration holds."""
    if value is None:
        return V.NIL
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


_NOT_LINEAR = re.compile(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<|[*+?}]\+")


def check_regex(pattern: str) -> str:
    """Patterns that need backtracking (look-around, references, possessive repeats) are refused."""
    if _NOT_LINEAR.search(re.sub(r"\\\\", "", pattern)):
        raise ConfigError(f"pattern {pattern!r}: look-around, references and possessive repeats are not supported")
    try:
        re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern))
    except re.error as e:
        raise ConfigError(f"pattern {pattern!r}: {e}") from e
    return pattern


def where_clause(clause: str, schema: T.StructType) -> Column:
    """A single ``field op value``; without an operator it is true. Numbers compare as numbers where both are."""
    for op in (">=", "<=", "!=", "==", ">", "<"):
        if op in clause:
            name, _, literal = (x.strip() for x in clause.partition(op))
            literal = literal.strip("'\"")
            kinds = {f.name: f.dataType for f in schema.fields}
            if name not in kinds:
                return F.lit(False)
            c, kind = F.col(f"`{name}`"), kinds[name]
            try:
                n = float(literal)
            except ValueError:
                return closed(_OPS[op](V.key_text(c, kind), F.lit(literal)))
            own = V.whole_number(c, kind)
            by_text = _OPS[op](V.key_text(c, kind), F.lit(literal))
            return closed(F.when(own.isNotNull(), _OPS[op](own, F.lit(n))).otherwise(by_text))
    return F.lit(True)


def glob_regex(pattern: str) -> str:
    """A glob of * and ? as an anchored regex that ignores case."""
    body = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern)
    return f"(?is)^{body}$"


def any_glob(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | closed(c.rlike(glob_regex(p)))
    return out
