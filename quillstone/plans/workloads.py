"""Three analytical queries over lineitem, orders and customer, and generated tables for them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.expr import col, lit
from quillstone.operators import Aggregate, Named, SortKey, aggregate, filter_rows, inner_join, limit_rows, project, sort_rows
from quillstone.sources.tables import widened


def generate(spark: SparkSession, rows: int) -> dict[str, DataFrame]:
    """Deterministic tables of `rows` lineitems, a quarter as many orders, a tenth of these customers."""
    orders = max(1, rows // 4)
    customers = max(1, orders // 10)
    line = spark.range(rows).select(
        F.expr(f"id % {orders}L").alias("l_orderkey"),
        F.expr("1 + id % 50").alias("l_quantity"),
        F.expr("10D + (17 * id) % 10000 / 10D").alias("l_extendedprice"),
        F.expr("(id % 11) / 100D").alias("l_discount"),
        F.expr("9000 + id % 365").alias("l_shipday"),
        F.expr("element_at(array('R', 'A', 'N'), cast(id % 3 as int) + 1)").alias("l_returnflag"),
        F.expr("if(id % 2 = 1, 'O', 'F')").alias("l_linestatus"),
    )
    order = spark.range(orders).select(F.col("id").alias("o_orderkey"), F.expr(f"id % {customers}L").alias("o_custkey"), F.expr("9000 + id % 200").alias("o_orderday"))
    customer = spark.range(customers).select(F.col("id").alias("c_custkey"), F.expr("if(id % 5 = 0, 'BUILDING', 'OTHER')").alias("c_mktsegment"))
    return {"lineitem": line, "orders": order, "customer": customer}


def of_days(df: DataFrame, stamp: str, day: str, first: int | None = None, until: int | None = None) -> DataFrame:
    """Widened columns with `stamp` as day number `day`; first <= day < until is tested on the stored
    timestamp, in the form that a Parquet reader can use to skip row groups."""
    at = lambda d: F.lit((datetime.date(1970, 1, 1) + datetime.timedelta(days=d)).isoformat()).cast(df.schema[stamp].dataType)
    if first is not None:
        df = df.filter(F.col(stamp) >= at(first))
    if until is not None:
        df = df.filter(F.col(stamp) < at(until))
    return widened(df).withColumnRenamed(stamp, day)


def q1(lineitem: DataFrame, until: int = 9300) -> DataFrame:
    """Totals by flag and status of what was shipped up to day `until`."""
    rows = filter_rows(lineitem, col("l_shipday") <= lit(until))
    price, discount = col("l_extendedprice"), col("l_discount")
    rows = project(rows, [Named("l_returnflag", "l_returnflag"), Named("l_linestatus", "l_linestatus"), Named("quantity", "l_quantity"), Named("price", "l_extendedprice"), Named("disc_price", price * (lit(1.0) - discount))])
    out = aggregate(rows, ["l_returnflag", "l_linestatus"], [Aggregate("sum_qty", "sum", "quantity"), Aggregate("sum_base_price", "sum", "price"), Aggregate("sum_disc_price", "sum", "disc_price"), Aggregate("count_order", "count")])
    return sort_rows(out, [SortKey("l_returnflag"), SortKey("l_linestatus")])


def q3(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, segment: str = "BUILDING", day: int = 9150, top: int = 10) -> DataFrame:
    """The unshipped orders of greatest revenue in a segment."""
    c = filter_rows(customer, col("c_mktsegment") == lit(segment))
    o = filter_rows(orders, col("o_orderday") < lit(day))
    line = filter_rows(lineitem, col("l_shipday") > lit(day))
    rows = inner_join(inner_join(c, o, ["c_custkey"], ["o_custkey"]), line, ["o_orderkey"], ["l_orderkey"])
    rows = project(rows, [Named("o_orderkey", "o_orderkey"), Named("o_orderday", "o_orderday"), Named("amount", col("l_extendedprice") * (lit(1.0) - col("l_discount")))])
    out = aggregate(rows, ["o_orderkey", "o_orderday"], [Aggregate("revenue", "sum", "amount")])
    return limit_rows(sort_rows(out, [SortKey("revenue", ascending=False), SortKey("o_orderday"), SortKey("o_orderkey")]), top)


def q6(lineitem: DataFrame, first: int = 9100, until: int = 9200, least: float = 0.05, most: float = 0.07, quantity=24) -> DataFrame:
    """Revenue that a change of discounts would have brought."""
    wanted = (col("l_shipday") >= lit(first)) & (col("l_shipday") < lit(until)) & (col("l_discount") >= lit(least)) & (col("l_discount") <= lit(most)) & (col("l_quantity") < lit(quantity))
    rows = project(filter_rows(lineitem, wanted), [Named("amount", col("l_extendedprice") * col("l_discount"))])
    return aggregate(rows, [], [Aggregate("revenue", "sum", "amount")])
