import math
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import Type, binary, col, describe, lit, null_literal, simplify
from quillstone.functions.expr import Binary, Lit, apply, expression_type, referenced_columns, same
from quillstone.operators import Named, filter_rows, project

MAX = (1 << 63) - 1
NAN, INF = float("nan"), float("inf")


def values(df):
    return [tuple(r) for r in df.collect()]


def one(df, e):
    return [r[0] for r in project(df, [Named("v", e)]).collect()]


def test_integer_arithmetic(frame):
    df = frame("x bigint, y bigint", [(7, 2), (1, None), (9, 0), (MAX, 1), (-7, 2), (-MAX - 1, -1)])
    x, y = col("x"), col("y")
    assert one(df, x / y) == [3, None, None, MAX, -3, None]
    assert one(df, x + y) == [9, None, 9, None, -5, None]
    assert one(df, x - y) == [5, None, 9, MAX - 1, -9, -MAX]
    assert one(df, x * y) == [14, None, 0, MAX, -14, None]


EDGES = [None, 0, 1, 2, 7, -1, -2, -7, 3037000499, 3037000500, -3037000500, 1 << 62, -(1 << 62), -(1 << 62) - 1, MAX // 3, MAX // 3 + 1, MAX - 1, MAX, -MAX, -MAX - 1]


@pytest.mark.parametrize("op", "+-*")
def test_overflow_is_null_at_every_edge(frame, op):
    df = frame("x bigint, y bigint", [(x, y) for x in EDGES for y in EDGES])
    x, y = col("x"), col("y")
    outs = {"flat": binary(op, x, y), "left": binary(op, x + lit(0), y), "right": binary(op, x, y - lit(0)), "both": binary(op, x * lit(1), y + lit(0)), "three": binary(op, binary(op, x, y), y), "large": binary(op, (x + y) - (x * y), (y + x) - (x + y))}
    for r in project(df, [Named("x", "x"), Named("y", "y"), *(Named(n, e) for n, e in outs.items())]).collect():
        want = apply(op, r.x, r.y)
        assert [r.flat, r.left, r.right, r.both] == [want] * 4, (r.x, r.y)
        total, times = apply("+", r.x, r.y), apply("*", r.x, r.y)
        assert [r.three, r.large] == [apply(op, want, r.y), apply(op, apply("-", total, times), apply("-", total, total))], (r.x, r.y)


@pytest.mark.parametrize("op", "+-*")
def test_overflow_is_null_with_literals(frame, op):
    df = frame("x bigint", [(x,) for x in EDGES])
    for v in EDGES[1:]:
        again = lit(MAX - 3) if op == "+" else lit(5)
        outs = {"a": binary(op, col("x"), lit(v)), "b": binary(op, lit(v), col("x")), "c": binary(op, again, binary(op, col("x"), lit(v))), "d": binary(op, lit(v) + lit(0), binary(op, col("x"), again))}
        for r in project(df, [Named("x", "x"), *(Named(n, e) for n, e in outs.items())]).collect():
            k = again.value
            assert tuple(r)[1:] == (apply(op, r.x, v), apply(op, v, r.x), apply(op, k, apply(op, r.x, v)), apply(op, v, apply(op, r.x, k))), (r.x, v)
    assert set(one(df, binary(op, col("x"), null_literal(Type.INT64)))) == {None}
    assert one(df.limit(1), binary(op, lit(MAX), lit(MAX))) == [apply(op, MAX, MAX)]


def test_overflow_and_zero_cost_no_exceptions(spark):
    """Rows that overflow, or divide by zero, take about as long as others, not a hundred times that."""
    df = spark.range(2_000_000).select(F.col("id").alias("x"), (F.col("id") * 0.0).alias("z"))

    def seconds(*exprs):
        started = time.time()
        project(df, [Named(f"v{i}", e) for i, e in enumerate(exprs)]).write.format("noop").mode("overwrite").save()
        return time.time() - started

    x, z = col("x"), col("z")
    of = lambda n, d: (lit(n) + x, lit(-n) - x, lit(n) * (x + lit(2)), (x + lit(n)) + x, z / (z + lit(d)))
    seconds(*of(1, 1.0))
    assert seconds(*of(MAX, 0.0)) < 5 * seconds(*of(1, 1.0)) + 3


def test_double_arithmetic(frame):
    df = frame("x double, y double", [(1.0, 0.0), (1.0, -0.0), (NAN, 0.0), (6.0, 4.0), (None, 1.0), (1e308, 1e-10)])
    assert one(df, col("x") / col("y"))[:5] == [None, None, None, 1.5, None]
    assert one(df, col("x") / col("y"))[5] == INF


def test_no_implicit_casts(frame):
    df = frame("x bigint, d double, s string, b boolean", [(1, 1.0, "a", True)])
    for e in (col("x") + lit(1.0), col("x") == lit(1.0), col("s") + col("s"), col("x") & col("b"), ~col("x"), col("b") + col("b"), col("s") < lit(1)):
        with pytest.raises(TypeError):
            project(df, [Named("v", e)])
    with pytest.raises(ValueError):
        project(df, [Named("v", col("none"))])
    with pytest.raises(TypeError):
        lit(None)
    with pytest.raises(TypeError):
        null_literal("bigint")
    with pytest.raises(ValueError):
        lit(1 << 63)
    with pytest.raises(TypeError):
        filter_rows(df, col("x"))
    with pytest.raises(TypeError):
        project(df, [Named("v", col("x"), Type.DOUBLE)])
    with pytest.raises(ValueError):
        project(df, [Named("v", col("x")), Named("v", col("d"))])


def test_columns_of_other_types_cannot_be_used(frame):
    df = frame("x bigint, i int", [(1, 2)])
    assert one(df, col("x")) == [1]
    with pytest.raises(TypeError):
        one(df, col("i"))


def test_three_valued_logic(frame):
    three = [False, True, None]
    df = frame("a boolean, b boolean", [(a, b) for a in three for b in three])
    assert one(df, col("a") & col("b")) == [False, False, False, False, True, None, False, None, None]
    assert one(df, col("a") | col("b")) == [False, True, None, True, True, True, None, True, None]
    assert one(df, ~col("a"))[6:] == [None] * 3
    assert one(df, col("a").is_null()) == [False] * 6 + [True] * 3
    assert len(values(filter_rows(df, col("a")))) == 3
    assert one(df, col("a") < col("b")) == [False, True, None, False, False, None, None, None, None]


OPS = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}


@pytest.mark.parametrize("op", OPS)
def test_doubles_compare_as_ieee_numbers(frame, op):
    points = [NAN, -INF, INF, 0.0, -0.0, 1.5, None]
    df = frame("x double, y double", [(x, y) for x in points for y in points])
    expected = [None if x is None or y is None else OPS[op](x, y) for x in points for y in points]
    assert one(df, binary(op, col("x"), col("y"))) == expected
    assert one(df, ~binary(op, col("x"), col("y"))) == [None if e is None else not e for e in expected]
    for v in points[:-1]:
        for e in (binary(op, col("x"), lit(v)), binary(op, lit(v), col("x"))):
            want = [x for x, y in zip([p for p in points for _ in points], points * 7) if x is not None and (OPS[op](x, v) if e.a is not None and isinstance(e.b, Lit) else OPS[op](v, x))]
            got = [r[0] for r in filter_rows(df, e).select("x").collect()]
            assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_nan_is_unequal_to_itself_in_filters(frame):
    df = frame("x double", [(NAN,), (1.0,), (None,)])
    assert len(values(filter_rows(df, col("x") != col("x")))) == 1
    assert values(filter_rows(df, col("x") == col("x"))) == [(1.0,)]


def test_strings_compare_by_bytes_and_hold_nul(frame):
    df = frame("s string", [("a\0b",), ("a",), ("Z",), ("é",), (None,)])
    assert one(df, col("s") > lit("a")) == [True, False, False, True, None]
    assert one(df, col("s") == lit("a\0b"))[0] is True


def test_filter_and_project(frame):
    df = frame("x bigint, label string", [(1, "a"), (None, None), (3, "c"), (7, "g")])
    rows = filter_rows(filter_rows(df, col("x") > lit(1)), col("x") < lit(5))
    assert values(project(rows, [Named("twice", col("x") * lit(2)), Named("label", "label")])) == [(6, "c")]


def test_simplify():
    c = col("c")
    assert same(simplify(lit(3) + lit(4)), lit(7))
    assert same(simplify(lit(3) / lit(0)), null_literal(Type.INT64))
    assert same(simplify(lit(True) & c), c) and same(simplify(lit(False) | c), c)
    assert same(simplify(lit(False) & c), lit(False)) and same(simplify(c | lit(True)), lit(True))
    assert same(simplify(c & c), c) and same(simplify(~~c), c)
    for kept in (c == c, c * lit(0)):
        assert same(simplify(kept), kept)


def test_describe_and_references():
    e = (col("a") < lit(9300)) & ~(col("b") == col("a")).is_null()
    assert describe(e) == "AND(<(a, 9300), NOT(IS NULL(=(b, a))))"
    assert referenced_columns(e) == ["a", "b"]
    assert not same(lit(1), lit(True)) and not same(lit(1), lit(1.0)) and same(lit(NAN), lit(NAN))
    with pytest.raises(TypeError):
        bool(col("a") == col("b"))


ints = st.one_of(st.none(), st.sampled_from([0, 1, -1, MAX, -MAX - 1]), st.integers(-MAX - 1, MAX))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(ints, ints), min_size=1, max_size=20))
def test_spark_and_constant_folding_agree(spark, rows):
    df = spark.createDataFrame(rows, "x bigint, y bigint")
    ops = ("+", "-", "*", "/", "=", "!=", "<", "<=", ">", ">=")
    got = project(df, [Named(f"v{i}", Binary(op, col("x"), col("y"))) for i, op in enumerate(ops)]).collect()
    assert [tuple(r) for r in got] == [tuple(apply(op, x, y) for op in ops) for x, y in rows]


def test_expression_type():
    schema = {"x": Type.INT64, "d": Type.DOUBLE}
    assert expression_type(col("x") + lit(1), schema) is Type.INT64
    assert expression_type(col("d") > lit(1.0), schema) is Type.BOOLEAN
    assert math.isinf(apply("*", 1e308, 10.0))
