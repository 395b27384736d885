"""Filter, projection, aggregation, inner equi-join, sort and limit on DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.expr import Expr, Lit, col, column, conjuncts, expression_type, simplify
from quillstone.functions.types import INT64_MAX, INT64_MIN, Type, column_type, schema_of, unique
from quillstone.plans.statistics import Statistics, in_order, smaller_side


def _name(n: str) -> Column:
    return F.col(f"`{n.replace('`', '``')}`")


def filter_rows(df: DataFrame, predicate: Expr, stats: Statistics | None = None) -> DataFrame:
    """Rows for which predicate is true (not NULL); conjuncts that can be are pushed to the scan.

    Constants are folded first. stats: of df; conjuncts are then tested from the most
    selective one on.
    """
    if expression_type(predicate, schema_of(df)) is not Type.BOOLEAN:
        raise TypeError("a filter takes a boolean")
    predicate = simplify(predicate)
    for c in conjuncts(predicate) if stats is None else in_order(predicate, stats):
        if not (isinstance(c, Lit) and c.value is True):
            df = df.filter(column(c, df, conjunct=True))
    return df


@dataclass(frozen=True)
class Named:
    """An output column; type, where given, must be that of the expression."""

    name: str
    expr: Expr | str
    type: Type | None = None


def project(df: DataFrame, outputs: list[Named]) -> DataFrame:
    """Named expressions; a string stands for the column of that name."""
    unique(o.name for o in outputs)
    schema, cols = schema_of(df), []
    for o in outputs:
        e = col(o.expr) if isinstance(o.expr, str) else o.expr
        kind = expression_type(e, schema)
        if o.type is not None and o.type is not kind:
            raise TypeError(f"{o.name} is declared {o.type.value} but is {kind.value}")
        cols.append(column(e, df).alias(o.name))
    return df.select(cols)


@dataclass(frozen=True)
class Aggregate:
    """function: count, sum, min or max; input None: rows (count only)."""

    name: str
    function: str
    input: str | None = None
    type: Type | None = None


def aggregate_type(a: Aggregate, schema) -> Type:
    if a.function not in ("count", "sum", "min", "max"):
        raise ValueError(f"unknown aggregate {a.function}")
    if a.function == "count":
        kind = Type.INT64
        if a.input is not None:
            column_type(schema, a.input)
    else:
        if a.input is None:
            raise TypeError(f"{a.function} takes a column")
        kind = column_type(schema, a.input)
        if not kind.numeric:
            raise TypeError(f"{a.function} takes numbers")
    if a.type is not None and a.type is not kind:
        raise TypeError(f"{a.name} is declared {a.type.value} but is {kind.value}")
    return kind


def int_sum(c: Column) -> Column:
    """Exact sum of 64-bit integers, NULL if it does not fit, whatever the order of the rows.

    Three limbs are summed as 64-bit integers, which holds for 2**39 rows and stays in
    generated code; a sum in decimals would not.
    """
    low, mid, high = F.sum(c.bitwiseAND(0xFFFFF)), F.sum(F.shiftright(c, 20).bitwiseAND(0xFFFFF)), F.sum(F.shiftright(c, 40))
    wide = lambda x: x.cast("decimal(20,0)")
    total = wide(high) * F.lit(1 << 40).cast("decimal(13,0)") + wide(mid) * F.lit(1 << 20).cast("decimal(7,0)") + wide(low)
    fits = (total >= F.lit(INT64_MIN).cast("decimal(38,0)")) & (total <= F.lit(INT64_MAX).cast("decimal(38,0)"))
    return F.when(fits, total.cast("long"))


def aggregate(df: DataFrame, keys: list[str], aggregates: list[Aggregate]) -> DataFrame:
    """Keys, then aggregates. No keys: one row, of empty input too; no aggregates: distinct keys.

    NULLs of a key are one group, as are NaNs and both zeros.
    """
    schema = schema_of(df)
    unique([*keys, *(a.name for a in aggregates)])
    for k in keys:
        column_type(schema, k)
    cols = []
    for a in aggregates:
        kind = aggregate_type(a, schema)
        c = None if a.input is None else _name(a.input)
        if a.function == "count":
            out = F.count(F.lit(1) if c is None else c)
        elif a.function == "sum":
            out = int_sum(c) if kind is Type.INT64 else F.sum(c)
        else:
            out = F.min(c) if a.function == "min" else F.max(c)
        cols.append(out.alias(a.name))
    if not keys and not cols:
        raise ValueError("an aggregate has keys or aggregates")
    if not cols:
        return df.select([_name(k) for k in keys]).distinct()
    return df.groupBy([_name(k) for k in keys]).agg(*cols) if keys else df.agg(*cols)


def inner_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], build: str | None = None, rows: tuple[float, float] | None = None, tiles: int = 1) -> DataFrame:
    """Rows with equal keys, columns of left, then right; NULL and NaN keys match nothing.

    build: "left" or "right" asks for a hash join built from that side, "smaller" from the
    side with fewer of `rows` (estimates of either, right if alike); None leaves the choice
    to statistics and the adaptive planner. A side to build from should fit a task's memory
    by its share of partitions.

    tiles: for few keys with many rows on both sides, where pairs grow with the square of the
    rows and the adaptive planner, which goes by bytes read, would leave them to a few tasks.
    The rows of a key are dealt to so many tiles by their hash, the side to build from (right,
    if none is named) is copied to each, and tiles go to spark.sql.shuffle.partitions tasks.
    Rows moved grow with the input. Rows alike in all columns share a tile.
    """
    if build == "smaller":
        if rows is None:
            raise ValueError("the smaller side is told by rows")
        build = smaller_side(*rows)
    if not left_keys or len(left_keys) != len(right_keys):
        raise ValueError("a join takes as many keys, one at least, of either side")
    unique([*left.columns, *right.columns])
    x, y = schema_of(left), schema_of(right)
    for a, b in zip(left_keys, right_keys):
        if column_type(x, a) is not column_type(y, b):
            raise TypeError(f"join keys {a} and {b} are of different types")
        if x[a] is Type.DOUBLE:
            left, right = left.filter(~F.isnan(_name(a))), right.filter(~F.isnan(_name(b)))
    if tiles < 1:
        raise ValueError("there is one tile at least")
    out, on = [*left.columns, *right.columns], list(zip(left_keys, right_keys))
    if tiles > 1:
        dealt = lambda df: F.pmod(F.xxhash64(*map(_name, df.columns)), F.lit(tiles)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
        left, right = left.withColumn("__left_tile", each if build == "left" else dealt(left)), right.withColumn("__right_tile", dealt(right) if build == "left" else each)
        on.append(("__left_tile", "__right_tile"))
        # by number: such partitions are not coalesced
        n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = left.repartition(n, *(_name(a) for a, _ in on)), right.repartition(n, *(_name(b) for _, b in on))
    if build == "left":
        left = left.hint("shuffle_hash")
    elif build == "right":
        right = right.hint("shuffle_hash")
    elif build is not None:
        raise ValueError("build is left, right, smaller or None")
    return left.join(right, [_name(a) == _name(b) for a, b in on], "inner").select([_name(c) for c in out])


@dataclass(frozen=True)
class SortKey:
    name: str
    ascending: bool = True
    nulls_first: bool = False


def sort_rows(df: DataFrame, keys: list[SortKey], ordinal: str | tuple[str, ...] | None = None) -> DataFrame:
    """Sorted by keys; NULLs last unless asked, in either direction; NaN above all numbers.

    ordinal: columns of input positions that order ties, which makes the sort stable.
    """
    schema, order = schema_of(df), []
    for k in keys:
        column_type(schema, k.name)
        c = _name(k.name)
        order.append((c.asc_nulls_first() if k.nulls_first else c.asc_nulls_last()) if k.ascending else (c.desc_nulls_first() if k.nulls_first else c.desc_nulls_last()))
    order += [_name(o).asc() for o in ((ordinal,) if isinstance(ordinal, str) else ordinal or ())]
    return df.orderBy(*order) if order else df


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows; after a sort Spark keeps the n best of each task only."""
    if n < 0:
        raise ValueError("a limit is not negative")
    return df.limit(n)
