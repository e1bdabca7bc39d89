"""A small predicate language (comparison and boolean) that becomes Spark columns or infix text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class Predicate:
    """Base of all nodes; ``&``, ``|`` and ``~`` combine them."""

    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)


def node(value: object) -> Predicate:
    """``value`` itself if it is a node, else a literal."""
    return value if isinstance(value, Predicate) else Literal(value)


@dataclass(frozen=True, eq=False)
class Literal(Predicate):
    value: object


@dataclass(frozen=True, eq=False)
class Reference(Predicate):
    """A field; comparison methods take nodes or plain values."""

    name: str

    def eq(self, other: object) -> Predicate:
        return Compare("=", self, node(other))

    def ne(self, other: object) -> Predicate:
        return Compare("<>", self, node(other))

    def gt(self, other: object) -> Predicate:
        return Compare(">", self, node(other))

    def lt(self, other: object) -> Predicate:
        return Compare("<", self, node(other))

    def ge(self, other: object) -> Predicate:
        return Compare(">=", self, node(other))

    def le(self, other: object) -> Predicate:
        return Compare("<=", self, node(other))

    def isin(self, values: object) -> Predicate:
        return In(self, tuple(node(v) for v in values))

    def between(self, low: object, high: object) -> Predicate:
        return Between(self, node(low), node(high))

    def like(self, pattern: object) -> Predicate:
        return Like(self, node(pattern))

    def is_null(self) -> Predicate:
        return IsNull(self)


@dataclass(frozen=True, eq=False)
class Compare(Predicate):
    sign: str
    left: Predicate
    right: Predicate


@dataclass(frozen=True, eq=False)
class And(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True, eq=False)
class Or(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True, eq=False)
class Not(Predicate):
    operand: Predicate


@dataclass(frozen=True, eq=False)
class In(Predicate):
    value: Predicate
    values: tuple[Predicate, ...]


@dataclass(frozen=True, eq=False)
class Between(Predicate):
    """Both ends are included."""

    value: Predicate
    low: Predicate
    high: Predicate


@dataclass(frozen=True, eq=False)
class Like(Predicate):
    value: Predicate
    pattern: Predicate


@dataclass(frozen=True, eq=False)
class IsNull(Predicate):
    operand: Predicate


def to_column(p: Predicate) -> Column:
    """The Spark column, with SQL's three-valued logic; membership in an empty list is false."""
    match p:
        case Literal(value):
            return F.lit(value)
        case Reference(name):
            return F.col(name)
        case Compare(sign, a, b):
            x, y = to_column(a), to_column(b)
            return {"=": x == y, "<>": x != y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[sign]
        case And(a, b):
            return to_column(a) & to_column(b)
        case Or(a, b):
            return to_column(a) | to_column(b)
        case Not(a):
            return ~to_column(a)
        case In(value, values):
            if all(isinstance(v, Literal) for v in values):
                return to_column(value).isin([v.value for v in values]) if values else F.lit(False)
            x = to_column(value)
            return reduce(lambda acc, v: acc | (x == to_column(v)), values[1:], x == to_column(values[0]))
        case Between(value, low, high):
            return to_column(value).between(to_column(low), to_column(high))
        case Like(value, Literal(pattern)):
            return to_column(value).like(pattern)
        case Like(value, pattern):
            return F.call_function("like", to_column(value), to_column(pattern))
        case IsNull(a):
            return to_column(a).isNull()
    raise TypeError(f"no predicate: {p!r}")


def infix(p: Predicate) -> str:
    """The predicate as text, with parentheses around every pair."""
    match p:
        case Literal(value):
            return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).upper() if isinstance(value, bool) else str(value)
        case Reference(name):
            return name
        case Compare(sign, a, b):
            return f"({infix(a)} {sign} {infix(b)})"
        case And(a, b):
            return f"({infix(a)} AND {infix(b)})"
        case Or(a, b):
            return f"({infix(a)} OR {infix(b)})"
        case Not(a):
            return f"NOT ({infix(a)})"
        case In(value, values):
            return f"({infix(value)} IN ({', '.join(map(infix, values))}))"
        case Between(value, low, high):
            return f"({infix(value)} BETWEEN {infix(low)} AND {infix(high)})"
        case Like(value, pattern):
            return f"({infix(value)} LIKE {infix(pattern)})"
        case IsNull(a):
            return f"({infix(a)} IS NULL)"
    raise TypeError(f"no predicate: {p!r}")


def fields(p: Predicate) -> set[str]:
    """Names of the fields that a predicate reads."""
    if isinstance(p, Reference):
        return {p.name}
    found: set[str] = set()
    for v in vars(p).values():
        for x in v if isinstance(v, tuple) else (v,):
            if isinstance(x, Predicate):
                found |= fields(x)
    return found
