"""Typed scalar expressions and their translation to columns.

Semantics differ from stock Spark where noted: integer overflow and division by zero
give NULL, integer division truncates, doubles compare as IEEE numbers (NaN is unequal
to everything), and operands are never cast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.types import INT64_MAX, INT64_MIN, Type, column_type, schema_of, type_of_value

ARITHMETIC, COMPARISON, LOGIC = ("+", "-", "*", "/"), ("=", "!=", "<", "<=", ">", ">="), ("AND", "OR")
FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


class Expr:
    """Immutable. Operators build expressions; == and != do too, structural equality is same(a, b)."""

    __hash__ = object.__hash__

    def __add__(self, o):
        return binary("+", self, o)

    def __sub__(self, o):
        return binary("-", self, o)

    def __mul__(self, o):
        return binary("*", self, o)

    def __truediv__(self, o):
        return binary("/", self, o)

    def __eq__(self, o):
        return binary("=", self, o)

    def __ne__(self, o):
        return binary("!=", self, o)

    def __lt__(self, o):
        return binary("<", self, o)

    def __le__(self, o):
        return binary("<=", self, o)

    def __gt__(self, o):
        return binary(">", self, o)

    def __ge__(self, o):
        return binary(">=", self, o)

    def __and__(self, o):
        return binary("AND", self, o)

    def __or__(self, o):
        return binary("OR", self, o)

    def __invert__(self):
        return unary("NOT", self)

    def is_null(self):
        return unary("IS NULL", self)

    def __bool__(self):
        raise TypeError("an expression has no truth value; use & | ~")


@dataclass(frozen=True, eq=False)
class Col(Expr):
    name: str


@dataclass(frozen=True, eq=False)
class Lit(Expr):
    value: object
    type: Type


@dataclass(frozen=True, eq=False)
class Unary(Expr):
    op: str
    a: Expr


@dataclass(frozen=True, eq=False)
class Binary(Expr):
    op: str
    a: Expr
    b: Expr


def col(name: str) -> Col:
    return Col(name)


def lit(value) -> Lit:
    return Lit(value, type_of_value(value))


def null_literal(kind: Type) -> Lit:
    if not isinstance(kind, Type):
        raise TypeError("a null literal needs one of the four types")
    return Lit(None, kind)


def _expr(x) -> Expr:
    return x if isinstance(x, Expr) else lit(x)


def unary(op: str, a) -> Unary:
    if op not in ("NOT", "IS NULL"):
        raise ValueError(f"unknown operator {op}")
    return Unary(op, _expr(a))


def binary(op: str, a, b) -> Binary:
    if op not in (*ARITHMETIC, *COMPARISON, *LOGIC):
        raise ValueError(f"unknown operator {op}")
    return Binary(op, _expr(a), _expr(b))


def expression_type(e: Expr, schema) -> Type:
    """The type of e over a schema; TypeError where operands do not fit, ValueError for unknown columns."""
    match e:
        case Col(name):
            return column_type(schema, name)
        case Lit(_, kind):
            return kind
        case Unary(op, a):
            kind = expression_type(a, schema)
            if op == "NOT" and kind is not Type.BOOLEAN:
                raise TypeError("NOT takes a boolean")
            return Type.BOOLEAN
        case Binary(op, a, b):
            x, y = expression_type(a, schema), expression_type(b, schema)
            if x is not y:
                raise TypeError(f"{op} takes operands of one type, not {x.value} and {y.value}")
            if op in ARITHMETIC:
                if not x.numeric:
                    raise TypeError(f"{op} takes numbers")
                return x
            if op in LOGIC and x is not Type.BOOLEAN:
                raise TypeError(f"{op} takes booleans")
            return Type.BOOLEAN
    raise TypeError(f"{e!r} is no expression")


def referenced_columns(e: Expr) -> list[str]:
    """Each column once, in order of first use."""
    match e:
        case Col(name):
            return [name]
        case Unary(_, a):
            return referenced_columns(a)
        case Binary(_, a, b):
            return list(dict.fromkeys(referenced_columns(a) + referenced_columns(b)))
    return []


def same(a: Expr, b: Expr) -> bool:
    """Structural equality; NaN literals are alike, 0.0 and -0.0 are not."""
    if type(a) is not type(b):
        return False
    match a:
        case Col(name):
            return name == b.name
        case Lit(value, kind):
            return kind is b.type and repr(value) == repr(b.value)
        case Unary(op, x):
            return op == b.op and same(x, b.a)
    return a.op == b.op and same(a.a, b.a) and same(a.b, b.b)


def describe(e: Expr) -> str:
    """Prefix text, such as <(l_shipday, 9300)."""
    match e:
        case Col(name):
            return name
        case Lit(value, _):
            return {None: "NULL", True: "TRUE", False: "FALSE"}[value] if value is None or isinstance(value, bool) else repr(value)
        case Unary(op, a):
            return f"{op}({describe(a)})"
    return f"{e.op}({describe(e.a)}, {describe(e.b)})"


def conjuncts(e: Expr) -> list[Expr]:
    if isinstance(e, Binary) and e.op == "AND":
        return conjuncts(e.a) + conjuncts(e.b)
    return [e]


# -- constants ---------------------------------------------------------------------------


def _wrap(n: int):
    return n if INT64_MIN <= n <= INT64_MAX else None


def apply(op: str, x, y):
    """A binary operator on two Python values of one type (None: NULL)."""
    if op == "AND":
        return False if x is False or y is False else None if x is None or y is None else True
    if op == "OR":
        return True if x is True or y is True else None if x is None or y is None else False
    if x is None or y is None:
        return None
    if op in COMPARISON:
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    if op == "/":
        if y == 0:
            return None
        if isinstance(x, int):
            q = abs(x) // abs(y)
            return _wrap(q if (x < 0) == (y < 0) else -q)
        return _ieee(lambda: x / y)
    r = _ieee(lambda: x + y if op == "+" else x - y if op == "-" else x * y)
    return _wrap(r) if isinstance(r, int) else r


def _ieee(f):
    try:
        return f()
    except OverflowError:
        return math.inf


def simplify(e: Expr) -> Expr:
    """Folds constants and boolean identities that hold for NULL and NaN as well.

    x = x and x * 0 are left as they are: NULL and NaN make them neither true nor zero.
    """
    match e:
        case Unary(op, a):
            a = simplify(a)
            if isinstance(a, Lit):
                return Lit(a.value is None, Type.BOOLEAN) if op == "IS NULL" else Lit(None if a.value is None else not a.value, Type.BOOLEAN)
            if op == "NOT" and isinstance(a, Unary) and a.op == "NOT":
                return a.a
            return Unary(op, a)
        case Binary(op, a, b):
            a, b = simplify(a), simplify(b)
            if isinstance(a, Lit) and isinstance(b, Lit):
                if a.type is not b.type:
                    raise TypeError(f"{op} takes operands of one type")
                return Lit(apply(op, a.value, b.value), a.type if op in ARITHMETIC else Type.BOOLEAN)
            if op in LOGIC:
                for x, y in ((a, b), (b, a)):
                    if isinstance(x, Lit) and x.value is not None:
                        return y if x.value is (op == "AND") else Lit(op == "OR", Type.BOOLEAN)
                if same(a, b):
                    return a
            return Binary(op, a, b)
    return e


# -- columns -----------------------------------------------------------------------------


def _is_nan(e: Expr, c: Column) -> Column | None:
    """A test for NaN, or None where a literal rules it out."""
    if isinstance(e, Lit):
        return F.lit(True) if e.value is not None and math.isnan(e.value) else None
    return F.isnan(c)


def _compare(op: str, x: Column, y: Column) -> Column:
    return {"=": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()


def _nodes(e: Expr) -> int:
    return 1 + sum(_nodes(v) for v in vars(e).values() if isinstance(v, Expr))


def _within(x: Column, below, above) -> Column:
    """x, NULL where it is not between bounds (exclusive; None or NULL: none). Names x once, as copies would double at each level."""
    for clip, bound in ((F.least, above), (F.greatest, below)):
        if bound is not None:
            bound = bound if isinstance(bound, Column) else F.lit(bound).cast("long")
            x = F.nullif(clip(x, bound), bound)
    return x


#: The larger operand of + - * is named once, the other up to 19 times; beyond so many nodes that is left to try_ alone, else plans grow too large.
GUARDED_NODES = 3


def _exact(e: Binary, x: Column, y: Column) -> Column:
    """+, - or * of 64-bit integers, NULL on overflow; constants are folded before.

    Spark's try_ functions throw and catch an exception for each row that overflows, which
    takes some 18 microseconds. So the larger operand is held to the bounds within which the
    other lets it fit, by steps that fit for every row, and nothing is thrown.
    Sums within the bounds are written such that Spark has no two literals to bring together.
    """
    swap = not isinstance(e.b, Lit) and (isinstance(e.a, Lit) or _nodes(e.a) < _nodes(e.b))
    of, a, b = (e.a, y, x) if swap else (e.b, x, y)  # a is held to bounds that b gives
    below = above = None
    if isinstance(of, Lit):
        if of.value is not None:
            below, above = _bounds(e.op, of.value, swap)
    elif _nodes(of) <= GUARDED_NODES:
        low, high, n = F.lit(INT64_MIN).cast("long"), F.lit(INT64_MAX).cast("long"), lambda v: F.lit(v).cast("long")
        least, most = (lambda v: F.greatest(b, n(v))), (lambda v: F.least(b, n(v)))
        if e.op == "+":
            below, above = F.when(b < 0, low - (most(-1) + 1)), F.when(b > 0, high - (least(1) - 1))
        elif e.op == "-" and not swap:
            below, above = F.when(b > 0, least(1) - high - 2), F.when(b < 0, most(-1) - low)
        elif e.op == "-":
            below, above = F.when(b >= 0, least(0) + low), F.when(b < -1, most(-2) + 1 - low)
        else:
            div = lambda v, by: F.call_function("div", v, by)
            below = F.when(b > 1, div(low, least(2)) - 1).when(b < -1, div(high, most(-2)) - 1).when(b == -1, low)
            above = F.when(b > 1, div(high, least(2)) + 1).when(b < -1, div(low, most(-2)) + 1)
    a = _within(a, below, above)
    x, y = (b, a) if swap else (a, b)
    return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[e.op](x, y)


def _bounds(op: str, b: int, swapped: bool) -> tuple[int | None, int | None]:
    """Exclusive bounds of the a for which a op b (swapped: b op a) fits; None where every a does."""
    if op == "*" and b == 0:
        return None, None
    if op == "*":
        ends = sorted((INT64_MIN / Fraction(b), INT64_MAX / Fraction(b)))
    elif op == "+":
        ends = [INT64_MIN - b, INT64_MAX - b]
    else:
        ends = [b - INT64_MAX, b - INT64_MIN] if swapped else [INT64_MIN + b, INT64_MAX + b]
    below, above = math.ceil(ends[0]) - 1, math.floor(ends[1]) + 1
    return below if below >= INT64_MIN else None, above if above <= INT64_MAX else None


def to_column(e: Expr, schema, conjunct: bool = False) -> Column:
    """The column of e. conjunct: e stands alone under AND in a filter, where FALSE does for NULL;
    comparisons with a literal then keep a form that Parquet readers can take."""
    kind = expression_type(e, schema)
    if kind is Type.INT64:
        e = simplify(e)
    match e:
        case Col(name):
            return F.col(f"`{name.replace('`', '``')}`")
        case Lit(value, _):
            return F.lit(value).cast(kind.spark)
        case Unary("NOT", a):
            return ~to_column(a, schema)
        case Unary(_, a):
            return to_column(a, schema).isNull()
    op, x, y = e.op, to_column(e.a, schema), to_column(e.b, schema)
    of = expression_type(e.a, schema)
    if op == "AND":
        return x & y
    if op == "OR":
        return x | y
    if op in ARITHMETIC:
        if of is Type.INT64:
            if op == "/":
                least = F.lit(INT64_MIN).cast("long")
                fails = (y == 0) | ((x == least) & (y == -1))
                # the guarded operands keep `div` from failing on rows that CASE would skip
                return F.when(~fails, F.call_function("div", x, F.when(~fails, y)))
            return _exact(e, x, y)
        if op == "/":
            return F.try_divide(x, y)
        return x + y if op == "+" else x - y if op == "-" else x * y
    if of is not Type.DOUBLE:
        return _compare(op, x, y)
    nans = [n for n in (_is_nan(e.a, x), _is_nan(e.b, y)) if n is not None]
    if not nans:
        return _compare(op, x, y)
    literal = next((s for s in (e.a, e.b) if isinstance(s, Lit)), None)
    if conjunct and literal is not None and literal.value is not None and not math.isnan(literal.value):
        # Spark's NaN is above every number: only "above" needs a guard
        above = (op if literal is e.b else FLIPPED[op]) in (">", ">=")
        return _compare(op, x, y) & ~nans[0] if above else _compare(op, x, y)
    nan = nans[0] if len(nans) == 1 else nans[0] | nans[1]
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("boolean")).when(nan, F.lit(op == "!=")).otherwise(_compare(op, x, y))


def column(e: Expr, df: DataFrame, conjunct: bool = False) -> Column:
    return to_column(e, schema_of(df), conjunct)
