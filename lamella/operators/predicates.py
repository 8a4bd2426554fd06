"""Typed predicates with two-valued logic, compiled to Spark columns that push down to the scan.

A predicate is a small immutable tree. Leaves are true or false, never unknown: a null value satisfies ``eq(c, None)``,
``not_eq`` with a value and ``not_in`` without None, and no comparison. Negation is pushed to the leaves before compilation
(the negation of ``lt`` is ``gt_eq``, so both drop nulls), after which unknown and false filter alike and plain comparisons serve.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PredicateError(ValueError):
    """A predicate that its table's schema does not allow."""


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Compare(Predicate):
    """A column against a literal; op is eq, ne, lt, le, gt or ge."""

    column: str
    op: str
    value: Any


@dataclass(frozen=True)
class In(Predicate):
    column: str
    values: frozenset
    negated: bool = False


@dataclass(frozen=True)
class Contains(Predicate):
    """Some element that is not null satisfies the inner leaf, whose column is the repeated one."""

    inner: Predicate
    negated: bool = False

    @property
    def column(self) -> str:
        return self.inner.column


@dataclass(frozen=True)
class UserDefined(Predicate):
    """keep(series) -> boolean series over the values that are not null; accepts_null says what null does; the two callbacks prune by (min, max)."""

    column: str
    keep: Callable
    accepts_null: bool = False
    can_drop: Callable[[Any, Any], bool] = field(default=lambda lo, hi: False)
    inverse_can_drop: Callable[[Any, Any], bool] = field(default=lambda lo, hi: False)
    negated: bool = False


@dataclass(frozen=True)
class And(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Or(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Not(Predicate):
    inner: Predicate


def eq(column: str, value: Any) -> Predicate:
    return Compare(column, "eq", value)


def not_eq(column: str, value: Any) -> Predicate:
    return Compare(column, "ne", value)


def _ordered(column: str, op: str, value: Any) -> Predicate:
    if value is None:
        raise PredicateError(f"{op} needs a value; only eq and not_eq take None")
    return Compare(column, op, value)


def lt(column: str, value: Any) -> Predicate:
    return _ordered(column, "lt", value)


def lt_eq(column: str, value: Any) -> Predicate:
    return _ordered(column, "le", value)


def gt(column: str, value: Any) -> Predicate:
    return _ordered(column, "gt", value)


def gt_eq(column: str, value: Any) -> Predicate:
    return _ordered(column, "ge", value)


def is_in(column: str, values: Iterable) -> Predicate:
    values = frozenset(values)
    if not values:
        raise PredicateError("a set of values must not be empty")
    return In(column, values)


def not_in(column: str, values: Iterable) -> Predicate:
    return In(column, is_in(column, values).values, True)


def contains(inner: Predicate) -> Predicate:
    if not isinstance(inner, (Compare, In)):
        raise PredicateError("contains takes a comparison or a set membership")
    if (isinstance(inner, Compare) and inner.value is None) or (isinstance(inner, In) and None in inner.values):
        raise PredicateError("elements are never compared with null")
    return Contains(inner)


def user_defined(column: str, keep: Callable | type, **more) -> Predicate:
    """A predicate from a function of a series, or from a class or an object with keep() and, where it has them, accepts_null, can_drop() and
    inverse_can_drop(). A class is made without arguments."""
    if isinstance(keep, type):
        keep = keep()
    if hasattr(keep, "keep"):
        more = {k: getattr(keep, k) for k in ("accepts_null", "can_drop", "inverse_can_drop") if hasattr(keep, k)} | more
        keep = keep.keep
    return UserDefined(column, keep, **more)


def all_of(*parts: Predicate) -> Predicate:
    return reduce(And, parts)


def any_of(*parts: Predicate) -> Predicate:
    return reduce(Or, parts)


_OPPOSITE = {"eq": "ne", "ne": "eq", "lt": "ge", "ge": "lt", "gt": "le", "le": "gt"}


def normalize(p: Predicate, negate: bool = False) -> Predicate:
    """The same predicate without Not: negation moves to the leaves, And and Or swap under it."""
    match p:
        case Not(inner):
            return normalize(inner, not negate)
        case And(a, b) | Or(a, b):
            kind = And if isinstance(p, And) != negate else Or
            return kind(normalize(a, negate), normalize(b, negate))
        case Compare(c, op, v):
            return Compare(c, _OPPOSITE[op], v) if negate else p
        case In(c, v, n):
            return In(c, v, n != negate)
        case Contains(inner, n):
            return Contains(inner, n != negate)
        case UserDefined():
            return UserDefined(p.column, p.keep, p.accepts_null, p.can_drop, p.inverse_can_drop, p.negated != negate)
    raise PredicateError(f"not a predicate: {p!r}")


def leaves(p: Predicate) -> list[Predicate]:
    match p:
        case And(a, b) | Or(a, b):
            return leaves(a) + leaves(b)
        case Not(inner):
            return leaves(inner)
    return [p]


def columns(p: Predicate) -> list[str]:
    """The columns a predicate reads, each once."""
    return list(dict.fromkeys(x.column for x in leaves(p)))


_MAP_PARTS = {".key_value.key": 0, ".key_value.value": 1, ".key": 0, ".value": 1}


def type_of(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a dotted path; steps into lists of structs make lists; None where the schema has no such column."""
    here: T.DataType = schema
    for k, step in enumerate(parts := path.split(".")):
        if isinstance(here, T.ArrayType) and isinstance(here.elementType, T.StructType) and step in here.elementType.names:
            inner = type_of(here.elementType, ".".join(parts[k:]))
            return None if inner is None else inner if isinstance(inner, T.ArrayType) else T.ArrayType(inner)
        if isinstance(here, T.MapType) and step in ("key_value", "key", "value"):
            return T.ArrayType(here.keyType if parts[-1] == "key" else here.valueType)
        if not isinstance(here, T.StructType) or step not in here.names:
            return None
        here = here[step].dataType
    return here


_PYTHON = {
    T.BooleanType: (bool,), T.ByteType: (int,), T.ShortType: (int,), T.IntegerType: (int,), T.LongType: (int,), T.FloatType: (float, int), T.DoubleType: (float, int),
    T.StringType: (str,), T.BinaryType: (bytes, bytearray), T.DecimalType: (Decimal, int),
}


def validate(p: Predicate, schema: T.StructType) -> None:
    """Raise PredicateError where a predicate does not fit: repeated columns only under contains and the reverse, values of the column's type,
    no order on booleans, no predicate on groups. Columns that the schema lacks are allowed: they read as null."""
    used: dict[str, type] = {}
    for leaf in leaves(p):
        repeated = isinstance(leaf, Contains)
        test = leaf.inner if repeated else leaf
        kind = type_of(schema, leaf.column)
        if kind is None:
            continue
        if repeated != isinstance(kind, T.ArrayType):
            raise PredicateError(f"{leaf.column} is {'not ' * repeated}repeated: {'only repeated columns can be' if repeated else 'use'} contains")
        kind = kind.elementType if repeated else kind
        if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
            raise PredicateError(f"{leaf.column} is a group; predicates take primitive columns")
        values = [] if isinstance(test, UserDefined) else [test.value] if isinstance(test, Compare) else list(test.values)
        if isinstance(kind, T.BooleanType) and isinstance(test, Compare) and test.op not in ("eq", "ne"):
            raise PredicateError(f"{leaf.column} is boolean: it has no order")
        allowed = _PYTHON.get(type(kind))
        for v in (v for v in values if v is not None):
            if allowed and (not isinstance(v, allowed) or (isinstance(v, bool) and bool not in allowed)):
                raise PredicateError(f"{leaf.column} is {kind.simpleString()}; {v!r} is not")
            if used.setdefault(leaf.column, type(v)) is not type(v) and not {used[leaf.column], type(v)} <= {int, float, Decimal}:
                raise PredicateError(f"{leaf.column} is compared with values of two types")


_COMPARE = {"lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


def _leaf(test: Predicate, c: Column) -> Column:
    match test:
        case Compare(_, "eq", None):
            return c.isNull()
        case Compare(_, "ne", None):
            return c.isNotNull()
        case Compare(_, "eq", v):
            return c.eqNullSafe(v)
        case Compare(_, "ne", v):
            return ~c.eqNullSafe(v)
        case Compare(_, op, v):
            return _COMPARE[op](c, F.lit(v))
        case In(_, values, negated):
            known = [v for v in values if v is not None]
            member = c.isin(known) if known else F.lit(False)
            if negated:
                return (c.isNotNull() & ~member) if None in values else (c.isNull() | ~member)
            return (c.isNull() | member) if None in values else member
    raise PredicateError(f"not a leaf: {test!r}")


def resolve(schema: T.StructType, path: str) -> Column:
    """The column at a dotted path; a null where the schema has none; keys or values of a map as a list."""
    if type_of(schema, path) is None:
        return F.lit(None)
    for suffix, which in _MAP_PARTS.items():
        stem = path.removesuffix(suffix)
        if stem != path and isinstance(type_of(schema, stem), T.MapType):
            return (F.map_values if which else F.map_keys)(resolve(schema, stem))
    return reduce(lambda c, step: c[step] if c is not None else F.col(f"`{step}`"), path.split("."), None)


def compile_predicate(p: Predicate, schema: T.StructType) -> Column:
    """The Spark column of a predicate that fits the schema. Comparisons on plain columns reach the scan as pushed filters."""
    validate(p, schema)

    def build(q: Predicate) -> Column:
        match q:
            case And(a, b):
                return build(a) & build(b)
            case Or(a, b):
                return build(a) | build(b)
            case Contains(inner, negated):
                if type_of(schema, q.column) is None:
                    return F.lit(negated)
                found = F.coalesce(F.exists(resolve(schema, q.column), lambda v: v.isNotNull() & _leaf(inner, v)), F.lit(False))
                return ~found if negated else found
            case UserDefined():
                c = resolve(schema, q.column)
                kept = F.coalesce(F.pandas_udf(q.keep, "boolean")(c), F.lit(False))
                kept = F.when(c.isNull(), F.lit(q.accepts_null)).otherwise(kept)
                return ~kept if q.negated else kept
        return _leaf(q, resolve(schema, q.column))

    return build(normalize(p))


def apply_filter(df: DataFrame, p: Predicate | None) -> DataFrame:
    """The rows of df that satisfy p; None keeps all."""
    return df if p is None else df.where(compile_predicate(p, df.schema))


# The older style of filter: one column and a function of its values, combined by the same and / or / not, and pages.


def column_filter(column: str, test: Callable[[Column], Column]) -> Callable[[DataFrame], Column]:
    """A filter from a function of the column, such as ``lambda c: c.startswith("a")``; unknown counts as false."""
    return lambda df: F.coalesce(test(resolve(df.schema, column)), F.lit(False))


def equal_to(value: Any) -> Callable[[Column], Column]:
    return lambda c: c == F.lit(value)


def apply_function(keep: Callable, returns: str = "boolean") -> Callable[[Column], Column]:
    """A filter function from a function of pandas series."""
    return lambda c: F.pandas_udf(keep, returns)(c)


def and_filter(*parts):
    return lambda df: reduce(operator.and_, (p(df) for p in parts))


def or_filter(*parts):
    return lambda df: reduce(operator.or_, (p(df) for p in parts))


def not_filter(part):
    return lambda df: ~part(df)


def page(df: DataFrame, start: int, size: int, order: list[str]) -> DataFrame:
    """Rows start to start + size - 1, counted from 1, in the order given (ties have to be broken by it)."""
    if start < 1 or size < 0:
        raise PredicateError("pages count from 1 and have no negative size")
    return df.orderBy(*order).offset(start - 1).limit(size)
