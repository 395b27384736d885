import random

import pytest

from quillstone.functions import Type, col, lit, null_literal
from quillstone.functions.expr import COMPARISON, FLIPPED, binary, same
from quillstone.operators import filter_rows
from quillstone.plans.statistics import Statistics, analyze, estimate_selectivity, grouped_rows, in_order, may_match, merge, merge_all, smaller_side

NAN = float("nan")


def test_analyze_and_merge(frame):
    parts = [[(1, "a"), (2, "b")], [(20, "c"), (21, "d")], [(None, "e"), (None, "f")]]
    stats = [analyze(frame("x bigint, text string", p)) for p in parts]
    assert [may_match(col("x") < lit(5), s) for s in stats] == [True, False, False]
    whole = merge_all(stats)
    x = whole.columns["x"]
    assert (x.rows, x.nulls, x.min, x.max) == (6, 2, 1, 21) and 3 < x.distinct <= 4
    assert not may_match(lit(0) > col("x"), whole)
    assert may_match(col("x").is_null(), whole) and not may_match(col("text").is_null(), whole)
    assert not may_match(col("x") == null_literal(Type.INT64), whole)
    assert not may_match(col("x") == lit(1), stats[2])
    with pytest.raises(ValueError):
        merge(whole, Statistics(1, {}))


def test_may_match_rules(frame):
    s = analyze(frame("d double, k bigint", [(1.0, 5), (NAN, 5), (None, 5)]))
    assert s.columns["d"].has_nan and s.columns["d"].max == 1.0
    assert may_match(col("d") != lit(NAN), s) and not may_match(col("d") > lit(NAN), s)
    assert may_match(col("d") != lit(1.0), s)
    assert not may_match(col("k") != lit(5), s) and may_match(col("k") * lit(2) == lit(3), s)
    assert may_match(None, s) and not may_match(lit(False), s) and not may_match(null_literal(Type.BOOLEAN), s)
    assert not may_match((col("k") > lit(5)) & lit(True), s) and may_match((col("k") > lit(5)) | (col("k") == lit(5)), s)


def test_selectivity(frame):
    s = analyze(frame("x bigint, s string", [(i, str(i % 4)) for i in range(100)] + [(None, None)] * 100))
    assert estimate_selectivity(col("x").is_null(), s) == 0.5
    assert abs(estimate_selectivity(col("x") < lit(25), s) - 0.125) < 0.01
    assert abs(estimate_selectivity(col("s") == lit("1"), s) - 0.125) < 0.01
    assert estimate_selectivity(col("x") > lit(1000), s) == 0
    both = (col("x") < lit(50)) & (col("x") == lit(7))
    assert estimate_selectivity(both, s) < 0.01
    assert [same(a, b) for a, b in zip(in_order(both & lit(True) & both, s), [both.b, both.a])] == [True, True]
    assert estimate_selectivity((col("x") < lit(50)) | (col("x") < lit(50)), s) == pytest.approx(0.2525 * 2 - 0.2525**2, abs=0.01)
    assert grouped_rows([], s) == 1 and 4 <= grouped_rows(["s"], s) <= 6
    assert smaller_side(1, 2) == "left" and smaller_side(2, 2) == "right"


def test_selectivity_where_nothing_is_known(frame):
    s = analyze(frame("x bigint, k bigint, d double", [(i, 5, v) for i, v in enumerate((-1.7e308, 0.0, 1.7e308, None))]))
    assert estimate_selectivity(col("d").is_null(), s) == 0.5  # whatever the share of NULLs
    assert estimate_selectivity(col("k") <= lit(5), s) == 0.5  # no width
    assert estimate_selectivity(col("d") < lit(0.0), s) == 0.375  # a width that no double holds
    assert estimate_selectivity(col("x").is_null(), s) == 0  # there are none


def test_pruning_never_loses_a_row(frame):
    rnd = random.Random(7)
    for trial in range(6):
        data = [tuple(None if rnd.random() < 0.2 else v for v in (rnd.randrange(-20, 20), NAN if i % 13 == 0 else rnd.uniform(-20, 20), str(rnd.randrange(-20, 20)))) for i in range(127)]
        df = frame("i bigint, d double, s string", data).cache()
        stats = analyze(df)
        for op in COMPARISON:
            for c, v in (("i", rnd.randrange(-25, 25)), ("d", rnd.uniform(-25, 25)), ("s", str(rnd.randrange(-25, 25)))):
                for e in (binary(op, col(c), lit(v)), binary(FLIPPED[op], lit(v), col(c))):
                    assert may_match(e, stats) or filter_rows(df, e).isEmpty()
        df.unpersist()
