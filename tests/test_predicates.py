"""Predicates over the phonebook fixture, and normalisation as a property."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from lamella.operators import predicates as P
from lamella.plans import pruning

SCHEMA = "id BIGINT NOT NULL, name STRING, location STRUCT<lon: DOUBLE, lat: DOUBLE>, phoneNumbers STRUCT<phone: ARRAY<STRUCT<number: BIGINT, kind: STRING>>>, accounts MAP<STRING, DOUBLE>"


@pytest.fixture(scope="module")
def book(spark):
    rows = [
        (17, None, None, None, {"business": 1000.0, "personal": 500.0}),
        (18, "bob", None, None, None),
        (19, "alice", None, ([],), {"business": 2000.0, "retirement": 1000.0}),
        (20, "thing1", None, ([(5555555555, None)],), None),
        (27, "thing2", None, ([(1111111111, "home"), (2222222222, "cell")],), None),
        (28, "popular", None, ([(1111111111, "home"), (1111111111, "apartment"), (2222222222, None), (3333333333, "mobile")],), None),
        (30, None, None, ([(1111111111, "home")],), None),
        (31, None, None, ([(2222222222, "business")],), None),
    ]
    for i in range(100, 200):
        place = None if i % 3 == 0 else (float(i), float(2 * i) if i % 3 == 1 else None)
        rows.append((i, f"p{i}", place, ([(i, "cell")],), None))
    return spark.createDataFrame(rows, SCHEMA)


def ids(df, p):
    return [r["id"] for r in P.apply_filter(df, p).select("id").orderBy("id").collect()]


KIND = "phoneNumbers.phone.kind"


def kind(v):
    return P.contains(P.eq(KIND, v))


def test_not_contains(book):
    no_cell = ~kind("cell")
    assert ids(book, no_cell) == [17, 18, 19, 20, 28, 30, 31]
    assert ids(book, no_cell & ~kind("home")) == [17, 18, 19, 20, 31]
    assert ids(book, no_cell & ~kind("home") & ~kind("business")) == [17, 18, 19, 20]


def test_contains_of_several_elements(book):
    assert ids(book, kind("home") & kind("mobile")) == [28]
    assert ids(book, P.contains(P.is_in(KIND, ["business", "apartment"]))) == [28, 31]
    assert ids(book, P.contains(P.not_eq(KIND, "cell")) & P.lt("id", 100)) == [27, 28, 30, 31]


def test_nulls(book):
    assert ids(book, P.eq("name", None)) == [17, 30, 31]
    assert ids(book, P.not_eq("name", "bob") & P.lt("id", 28)) == [17, 19, 20, 27]
    assert ids(book, P.not_in("name", ["bob", None]) & P.lt("id", 28)) == [19, 20, 27]
    assert ids(book, P.is_in("name", ["bob", None])) == [17, 18, 30, 31]


def test_nested_and_map(book):
    assert ids(book, P.gt("location.lon", 150.0) & P.not_eq("location.lat", None)) == [i for i in range(151, 200) if i % 3 == 1]
    assert ids(book, P.contains(P.eq("accounts.key_value.key", "retirement"))) == [19]
    assert ids(book, P.contains(P.gt("accounts.value", 900.0))) == [17, 19]


def test_missing_columns_are_null(book):
    assert len(ids(book, P.not_eq("nope", 3))) == book.count()
    assert ids(book, P.gt("nope", 3) | P.eq("id", 18)) == [18]
    assert len(ids(book, ~P.contains(P.eq("nope", 3)))) == book.count()


@pytest.mark.parametrize("bad", [P.eq("id", "x"), P.eq("name", 3), P.contains(P.eq("name", "x")), P.eq("location", 1), P.eq(KIND, "home"), P.eq("id", True)])
def test_predicates_that_do_not_fit(book, bad):
    with pytest.raises(P.PredicateError):
        P.apply_filter(book, bad)


def test_constructors_refuse():
    for f in (lambda: P.lt("a", None), lambda: P.is_in("a", []), lambda: P.contains(P.eq("a", None)), lambda: P.contains(P.eq("a", 1) & P.eq("a", 2))):
        with pytest.raises(P.PredicateError):
            f()


def test_pushdown(spark, small):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    d = P.apply_filter(spark.read.parquet(f"{small}/lineitem.parquet"), ~(P.lt("l_quantity", 24.0) | P.not_eq("l_returnflag", "R")) & P.not_in("l_linestatus", ["O"]))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,24.0)" in plan and "EqualNullSafe(l_returnflag,R)" in plan and "Or(IsNull(l_linestatus)" in plan


VALUES = [None, 0, 1, 2, 3]
leaf = st.one_of(
    st.builds(lambda op, v: P.Compare("x", op, v), st.sampled_from(["lt", "le", "gt", "ge"]), st.integers(0, 3)),
    st.builds(lambda op, v: P.Compare("x", op, v), st.sampled_from(["eq", "ne"]), st.sampled_from(VALUES)),
    st.builds(lambda v, n: P.In("x", frozenset(v), n), st.sets(st.sampled_from(VALUES), min_size=1), st.booleans()),
)
tree = st.recursive(leaf, lambda t: st.one_of(st.builds(P.And, t, t), st.builds(P.Or, t, t), st.builds(P.Not, t)), max_leaves=6)


def holds(p, x, negate=False):
    """Two-valued truth under the rule that negation is that of the operator."""
    match p:
        case P.Not(q):
            return holds(q, x, not negate)
        case P.And(a, b):
            return (any if negate else all)(holds(q, x, negate) for q in (a, b))
        case P.Or(a, b):
            return (all if negate else any)(holds(q, x, negate) for q in (a, b))
        case P.In(_, v, n):
            return (x in v) != (n != negate)
        case P.Compare(_, "eq" | "ne" as op, v):
            return (x == v) == ((op == "eq") != negate)
        case P.Compare(_, op, v):
            op = P._OPPOSITE[op] if negate else op
            return x is not None and {"lt": x < v, "le": x <= v, "gt": x > v, "ge": x >= v}[op]


@given(tree)
@settings(max_examples=300, deadline=None)
def test_normalize_and_pruning_are_sound(p):
    q = P.normalize(p)
    assert all(holds(p, x) == holds(q, x) for x in VALUES)
    for part in ([0, 1], [2, 2], [None, None], [None, 3], [1]):
        known = [x for x in part if x is not None]
        stats = {"x": pruning.Bounds(len(part), part.count(None), min(known, default=None), max(known, default=None))}
        if pruning.can_drop(p, stats):
            assert not any(holds(p, x) for x in part)
        if pruning.dictionary_can_drop(p, {"x": set(known)}, {"x": part.count(None)}):
            assert not any(holds(p, x) for x in part)


@given(tree)
@settings(max_examples=12, deadline=None)
def test_compiled_predicates(spark, p):
    d = spark.createDataFrame([(x,) for x in VALUES], "x int")
    got = [r["x"] for r in P.apply_filter(d, p).collect()]
    assert sorted(map(str, got)) == sorted(str(x) for x in VALUES if holds(p, x))


def test_nan_guards():
    nan = float("nan")
    b = pruning.Bounds(3, 0, 1.0, 2.0, 0)
    assert pruning.can_drop(P.gt("x", 5.0), {"x": b}) and not pruning.can_drop(P.gt("x", 5.0), {"x": pruning.Bounds(3, 0, 1.0, 2.0)})
    assert not pruning.can_drop(P.eq("x", nan), {"x": b}) and not pruning.can_drop(P.eq("x", 5.0), {"x": pruning.Bounds(3, 0, nan, nan)})
    assert not pruning.can_drop(P.eq("x", 1), {})


def test_row_ranges():
    a, b = pruning.RowRanges.of((0, 4), (10, 12)), pruning.RowRanges.of((3, 10), (20, 21))
    assert (a | b).ranges == ((0, 12), (20, 21)) and (a & b).ranges == ((3, 4), (10, 10)) and (a | b).count == 15
    assert a.overlaps(11, 30) and not a.overlaps(5, 9)
    pages = {"x": [(0, pruning.Bounds(10, 0, 0, 4)), (10, pruning.Bounds(10, 0, 5, 9)), (20, pruning.Bounds(5, 5))]}
    assert pruning.page_ranges(P.gt("x", 4), pages, 25).ranges == ((10, 19),)
    assert pruning.page_ranges(P.not_eq("x", 2) | P.eq("y", 1), pages, 25).ranges == ((0, 24),)
    assert pruning.select_pages(pruning.RowRanges.of((3, 4), (22, 22)), [0, 10, 20], 25) == [0, 2]


def test_user_defined_pruning():
    p = P.user_defined("x", lambda s: s > 3, can_drop=lambda lo, hi: hi <= 3, inverse_can_drop=lambda lo, hi: lo > 3)
    assert pruning.can_drop(p, {"x": pruning.Bounds(2, 0, 1, 2)}) and not pruning.can_drop(~p, {"x": pruning.Bounds(2, 0, 1, 2)})
    assert pruning.can_drop(~p, {"x": pruning.Bounds(2, 0, 5, 6)}) and not pruning.can_drop(~p, {"x": pruning.Bounds(2, 1, 5, 6)})


def test_types_at_paths(book):
    assert P.type_of(book.schema, KIND) == T.ArrayType(T.StringType()) and P.type_of(book.schema, "location.x") is None
