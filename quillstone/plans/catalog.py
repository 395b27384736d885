"""The registered queries and their SQL for DuckDB.

Each query takes (spark, sf_dir) and reads whole tables. NULLs, NaNs and overflows that
the tables do not hold are made from their columns, as x / 0 or sums beyond 64 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import Type, col, lit, null_literal
from quillstone.operators import Aggregate, Named, SortKey, aggregate, filter_rows, inner_join, limit_rows, project, sort_rows
from quillstone.plans import workloads
from quillstone.plans.options import ExecutionOptions
from quillstone.plans.statistics import analyze, estimate_selectivity, may_match, merge_all
from quillstone.sources import MemoryTable, ParquetTable

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
MAX = (1 << 63) - 1


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> ParquetTable:
    return ParquetTable(spark, f"{sf_dir}/{name}.parquet", strict_types=False)


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(*names: str) -> list[Named]:
    return [Named(n, n) for n in names]


DAY = "date_diff('day', TIMESTAMP '1970-01-01', {})"


# -- scans -------------------------------------------------------------------------------


@_query("SELECT o_totalprice, o_orderkey FROM orders")
def scan_project_subset(spark, sf_dir):
    return _table(spark, sf_dir, "orders").scan(["o_totalprice", "o_orderkey"])


@_query("SELECT count(*) AS n FROM lineitem")
def scan_zero_column_count(spark, sf_dir):
    return aggregate(_table(spark, sf_dir, "lineitem").scan([]), [], [Aggregate("n", "count")])


# -- filters -----------------------------------------------------------------------------


@_query(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {DAY.format('l_shipdate')} AS l_shipday FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-12-01' AND l_shipdate < TIMESTAMP '1995-03-11'")
def filter_int_range(spark, sf_dir):
    df = workloads.of_days(_raw(spark, sf_dir, "lineitem"), "l_shipdate", "l_shipday", 9100, 9200)
    return project(filter_rows(df, (col("l_shipday") >= lit(9100)) & (col("l_shipday") < lit(9200))), _named("l_orderkey", "l_linenumber", "l_shipday"))


@_query("SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount >= 0.05 AND l_discount <= 0.07")
def filter_double_range(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").scan(["l_orderkey", "l_discount"], (col("l_discount") >= lit(0.05)) & (col("l_discount") <= lit(0.07)))


@_query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_string_eq(spark, sf_dir):
    return _table(spark, sf_dir, "customer").scan(["c_custkey", "c_name"], col("c_mktsegment") == lit("BUILDING"))


@_query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000.0) OR o_custkey < 10")
def filter_bool_logic(spark, sf_dir):
    return _table(spark, sf_dir, "orders").scan(["o_orderkey"], ~((col("o_orderstatus") == lit("F")) & (col("o_totalprice") > lit(100000.0))) | (col("o_custkey") < lit(10)))


def _with_nulls(spark, sf_dir) -> DataFrame:
    """ratio is NULL where the quantity less its half, doubled, is 0."""
    df = _table(spark, sf_dir, "lineitem").scan(["l_orderkey", "l_linenumber"])
    rest = col("l_orderkey") - (col("l_orderkey") / lit(3)) * lit(3)
    return project(df, [*_named("l_orderkey", "l_linenumber"), Named("ratio", col("l_orderkey") / rest)])


NULLS = "(SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_orderkey // (l_orderkey % 3) END AS ratio FROM lineitem)"


@_query(f"SELECT l_orderkey, l_linenumber FROM {NULLS} WHERE ratio IS NULL")
def filter_is_null(spark, sf_dir):
    return project(filter_rows(_with_nulls(spark, sf_dir), col("ratio").is_null()), _named("l_orderkey", "l_linenumber"))


@_query(f"SELECT l_orderkey, l_linenumber, ratio FROM {NULLS} WHERE ratio IS NOT NULL")
def filter_not_null(spark, sf_dir):
    return filter_rows(_with_nulls(spark, sf_dir), ~col("ratio").is_null())


@_query("SELECT p_partkey FROM part WHERE p_partkey > 50")
def filter_chain_dedup(spark, sf_dir):
    df = _table(spark, sf_dir, "part").scan(["p_partkey"])
    for _ in range(2):
        df = filter_rows(df, (col("p_partkey") > lit(50)) & lit(True))
    return df


# -- projections -------------------------------------------------------------------------


@_query("SELECT l_orderkey, l_orderkey + l_partkey AS added, l_orderkey - l_partkey AS less, l_orderkey * l_suppkey AS times FROM lineitem")
def project_arith_int(spark, sf_dir):
    o, p, s = col("l_orderkey"), col("l_partkey"), col("l_suppkey")
    return project(_table(spark, sf_dir, "lineitem").scan(), [Named("l_orderkey", "l_orderkey"), Named("added", o + p), Named("less", o - p), Named("times", o * s)])


@_query("SELECT l_orderkey, l_extendedprice * (1.0::DOUBLE - l_discount) AS net, l_extendedprice + l_tax AS added, l_extendedprice - l_tax AS less FROM lineitem")
def project_arith_double(spark, sf_dir):
    price, tax = col("l_extendedprice"), col("l_tax")
    return project(_table(spark, sf_dir, "lineitem").scan(), [Named("l_orderkey", "l_orderkey"), Named("net", price * (lit(1.0) - col("l_discount"))), Named("added", price + tax), Named("less", price - tax)])


@_query("SELECT l_orderkey, (0 - l_partkey) // 7 AS a, l_partkey // 7 AS b, l_partkey // -7 AS c FROM lineitem")
def project_int_div(spark, sf_dir):
    p = col("l_partkey")
    return project(_table(spark, sf_dir, "lineitem").scan(), [Named("l_orderkey", "l_orderkey"), Named("a", (lit(0) - p) / lit(7)), Named("b", p / lit(7)), Named("c", p / lit(-7))])


@_query("SELECT l_orderkey, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_orderkey // (l_linenumber - 2) END AS q FROM lineitem")
def project_int_div_zero_null(spark, sf_dir):
    return project(_table(spark, sf_dir, "lineitem").scan(), [Named("l_orderkey", "l_orderkey"), Named("q", col("l_orderkey") / (col("l_linenumber") - lit(2)))])


@_query("SELECT l_orderkey, CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END AS q FROM lineitem")
def project_double_div_zero_null(spark, sf_dir):
    return project(_table(spark, sf_dir, "lineitem").scan(), [Named("l_orderkey", "l_orderkey"), Named("q", col("l_extendedprice") / col("l_discount"))])


@_query(f"SELECT l_orderkey, TRY({MAX - 3} + CAST(l_linenumber AS BIGINT)) AS a, TRY({-MAX + 2} - CAST(l_linenumber AS BIGINT)) AS b, TRY({MAX // 3} * CAST(l_linenumber AS BIGINT)) AS c FROM lineitem")
def project_overflow_null(spark, sf_dir):
    n = col("l_linenumber")
    return project(_table(spark, sf_dir, "lineitem").scan(), [Named("l_orderkey", "l_orderkey"), Named("a", lit(MAX - 3) + n), Named("b", lit(-MAX + 2) - n), Named("c", lit(MAX // 3) * n)])


@_query(f"SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN NULL ELSE ({-MAX} - 1) // (0 - CAST(l_linenumber AS BIGINT)) END AS q FROM lineitem")
def project_int_div_min_null(spark, sf_dir):
    return project(_table(spark, sf_dir, "lineitem").scan(), [Named("l_orderkey", "l_orderkey"), Named("q", lit(-MAX - 1) / (lit(0) - col("l_linenumber")))])


@_query("SELECT o_orderkey, o_totalprice > 100000.0 AS a, o_orderstatus <= 'O' AS b, o_custkey != 7 AS c, (o_orderkey < 5) = (o_custkey < 5) AS d FROM orders")
def project_compare_values(spark, sf_dir):
    outs = [Named("o_orderkey", "o_orderkey"), Named("a", col("o_totalprice") > lit(100000.0)), Named("b", col("o_orderstatus") <= lit("O")), Named("c", col("o_custkey") != lit(7)), Named("d", (col("o_orderkey") < lit(5)) == (col("o_custkey") < lit(5)))]
    return project(_table(spark, sf_dir, "orders").scan(), outs)


INF = 1e308


def _with_nan(spark, sf_dir) -> DataFrame:
    """x is NaN on every third order: infinity less infinity."""
    df = _table(spark, sf_dir, "orders").scan(["o_orderkey", "o_custkey"])
    huge = F.when(F.col("o_orderkey") % 3 == 0, F.lit(INF)).otherwise(F.lit(0.0)) * 10
    return df.withColumn("x", huge - huge + (F.col("o_orderkey") % 5).cast("double"))


NANS = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'nan'::DOUBLE ELSE (o_orderkey % 5)::DOUBLE END AS x FROM orders)"


@_query(f"SELECT o_orderkey, NOT isnan(x) AS self, isnan(x) AS odd, NOT isnan(x) AND x > 2 AS above, isnan(x) OR x != 2 AS other FROM {NANS}")
def project_nan_compare(spark, sf_dir):
    x = col("x")
    return project(_with_nan(spark, sf_dir), [Named("o_orderkey", "o_orderkey"), Named("self", x == x), Named("odd", x != x), Named("above", x > lit(2.0)), Named("other", x != lit(2.0))])


@_query(f"SELECT o_orderkey FROM {NANS} WHERE NOT isnan(x) AND x > 2")
def filter_nan_above(spark, sf_dir):
    return project(filter_rows(_with_nan(spark, sf_dir), col("x") > lit(2.0)), _named("o_orderkey"))


@_query("SELECT r_name, CAST(7 AS BIGINT) AS i, 1.5::DOUBLE AS d, 'text' AS s, true AS b, CAST(NULL AS BIGINT) AS none FROM region")
def project_literals_and_typed_null(spark, sf_dir):
    return project(_table(spark, sf_dir, "region").scan(), [Named("r_name", "r_name"), Named("i", lit(7)), Named("d", lit(1.5)), Named("s", lit("text")), Named("b", lit(True)), Named("none", null_literal(Type.INT64))])


# -- aggregates --------------------------------------------------------------------------


@_query("SELECT count(*) AS n, count(l_partkey) AS n_part, CAST(sum(l_partkey) AS BIGINT) AS s, min(l_partkey) AS lo, max(l_partkey) AS hi, min(l_discount) AS dlo, max(l_discount) AS dhi FROM lineitem")
def agg_global_all(spark, sf_dir):
    aggs = [Aggregate("n", "count"), Aggregate("n_part", "count", "l_partkey"), Aggregate("s", "sum", "l_partkey"), Aggregate("lo", "min", "l_partkey"), Aggregate("hi", "max", "l_partkey"), Aggregate("dlo", "min", "l_discount"), Aggregate("dhi", "max", "l_discount")]
    return aggregate(_table(spark, sf_dir, "lineitem").scan(), [], aggs)


@_query("SELECT count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS s, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part WHERE p_partkey < 0")
def agg_global_empty(spark, sf_dir):
    df = filter_rows(_table(spark, sf_dir, "part").scan(), col("p_partkey") < lit(0))
    return aggregate(df, [], [Aggregate("n", "count"), Aggregate("s", "sum", "p_partkey"), Aggregate("lo", "min", "p_partkey"), Aggregate("hi", "max", "p_partkey")])


@_query("SELECT p_partkey, count(*) AS n FROM part WHERE p_partkey < 0 GROUP BY p_partkey")
def agg_grouped_empty(spark, sf_dir):
    return aggregate(filter_rows(_table(spark, sf_dir, "part").scan(), col("p_partkey") < lit(0)), ["p_partkey"], [Aggregate("n", "count")])


@_query("SELECT l_suppkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS s FROM lineitem GROUP BY l_suppkey")
def agg_group_single(spark, sf_dir):
    return aggregate(_table(spark, sf_dir, "lineitem").scan(), ["l_suppkey"], [Aggregate("n", "count"), Aggregate("s", "sum", "l_partkey")])


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group_composite(spark, sf_dir):
    return aggregate(_table(spark, sf_dir, "lineitem").scan(), ["l_returnflag", "l_linestatus"], [Aggregate("n", "count"), Aggregate("hi", "max", "l_extendedprice")])


@_query(f"SELECT ratio, count(*) AS n, count(ratio) AS valued FROM {NULLS} GROUP BY ratio")
def agg_group_null_key(spark, sf_dir):
    return aggregate(_with_nulls(spark, sf_dir), ["ratio"], [Aggregate("n", "count"), Aggregate("valued", "count", "ratio")])


@_query(f"SELECT CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE x END AS x, count(*) AS n FROM {NANS} GROUP BY 1")
def agg_group_nan_zero_key(spark, sf_dir):
    df = _with_nan(spark, sf_dir)
    signed = F.when((F.col("x") == 0) & (F.col("o_custkey") % 2 == 0), F.lit(-0.0)).otherwise(F.col("x"))
    return aggregate(df.withColumn("x", signed), ["x"], [Aggregate("n", "count")])


@_query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def agg_keys_only(spark, sf_dir):
    return aggregate(_table(spark, sf_dir, "lineitem").scan(), ["l_returnflag", "l_linestatus"], [])


@_query(f"SELECT l_linenumber, TRY_CAST(sum(CAST(big AS HUGEINT)) AS BIGINT) AS s FROM (SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_linenumber = 1 THEN {MAX} ELSE {MAX} // 10000000 END AS big FROM lineitem) GROUP BY l_linenumber")
def agg_sum_overflow_null(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").scan(["l_linenumber"])
    df = df.withColumn("big", F.when(F.col("l_linenumber") == 1, F.lit(MAX)).otherwise(F.lit(MAX // 10000000)))
    return aggregate(df, ["l_linenumber"], [Aggregate("s", "sum", "big")])


@_query(f"SELECT o_custkey, min(x) AS lo, max(x) AS hi FROM {NANS} GROUP BY o_custkey")
def agg_minmax_nan(spark, sf_dir):
    return aggregate(_with_nan(spark, sf_dir), ["o_custkey"], [Aggregate("lo", "min", "x"), Aggregate("hi", "max", "x")])


@_query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 590")
def agg_having(spark, sf_dir):
    return filter_rows(aggregate(_table(spark, sf_dir, "lineitem").scan(), ["l_suppkey"], [Aggregate("n", "count")]), col("n") > lit(590))


# -- joins -------------------------------------------------------------------------------


@_query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner_single(spark, sf_dir):
    df = inner_join(_table(spark, sf_dir, "orders").scan(["o_orderkey", "o_custkey"]), _table(spark, sf_dir, "customer").scan(["c_custkey", "c_name"]), ["o_custkey"], ["c_custkey"])
    return project(df, _named("o_orderkey", "c_name"))


@_query("SELECT a.l_orderkey, CAST(a.l_linenumber AS BIGINT) AS l_linenumber, b.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def join_inner_composite(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem")
    right = project(t.scan(), [Named("r_orderkey", "l_orderkey"), Named("r_linenumber", "l_linenumber"), Named("q", "l_quantity")])
    return project(inner_join(t.scan(["l_orderkey", "l_linenumber"]), right, ["l_orderkey", "l_linenumber"], ["r_orderkey", "r_linenumber"]), _named("l_orderkey", "l_linenumber", "q"))


@_query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def join_duplicates(spark, sf_dir):
    """Every customer with every supplier of the nation: customers times suppliers / 25 rows, in tiles."""
    df = inner_join(_table(spark, sf_dir, "customer").scan(["c_custkey", "c_nationkey"]), _table(spark, sf_dir, "supplier").scan(["s_suppkey", "s_nationkey"]), ["c_nationkey"], ["s_nationkey"], build="right", tiles=32)
    return project(df, _named("c_custkey", "s_suppkey"))


@_query(f"SELECT l_orderkey, l_linenumber, o_orderkey FROM {NULLS} JOIN orders ON ratio = o_orderkey")
def join_null_keys(spark, sf_dir):
    return project(inner_join(_with_nulls(spark, sf_dir), _table(spark, sf_dir, "orders").scan(["o_orderkey"]), ["ratio"], ["o_orderkey"]), _named("l_orderkey", "l_linenumber", "o_orderkey"))


@_query(f"SELECT x, count(*) AS n FROM {NANS} JOIN (SELECT CASE WHEN n_nationkey = 3 THEN 'nan'::DOUBLE ELSE n_nationkey::DOUBLE END AS y FROM nation) ON x = y WHERE NOT isnan(x) GROUP BY x")
def join_nan_keys(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").scan(["n_nationkey"])
    n = n.select(F.when(F.col("n_nationkey") == 3, F.lit(float("nan"))).otherwise(F.col("n_nationkey").cast("double")).alias("y"))
    return aggregate(inner_join(_with_nan(spark, sf_dir), n, ["x"], ["y"]), ["x"], [Aggregate("n", "count")])


@_query("SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_three_way(spark, sf_dir):
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    df = inner_join(inner_join(c.scan(["c_custkey", "c_nationkey"]), n.scan(["n_nationkey", "n_regionkey"]), ["c_nationkey"], ["n_nationkey"]), r.scan(["r_regionkey", "r_name"]), ["n_regionkey"], ["r_regionkey"])
    return aggregate(df, ["r_name"], [Aggregate("n", "count")])


# -- sorts and limits --------------------------------------------------------------------


def _sorted(keys: list[SortKey]):
    def run(spark, sf_dir):
        return sort_rows(_with_nulls(spark, sf_dir), [*keys, SortKey("l_orderkey"), SortKey("l_linenumber")])

    return run


for _n, _keys, _sql in (
    ("sort_multi_nulls_last", [SortKey("ratio")], "ratio ASC NULLS LAST"),
    ("sort_desc_nulls_last", [SortKey("ratio", ascending=False)], "ratio DESC NULLS LAST"),
    ("sort_nulls_first", [SortKey("ratio", nulls_first=True)], "ratio ASC NULLS FIRST"),
    ("sort_desc_nulls_first", [SortKey("ratio", ascending=False, nulls_first=True)], "ratio DESC NULLS FIRST"),
):
    QUERIES[_n] = _sorted(_keys)
    ORACLE_SQL[_n] = f"SELECT * FROM {NULLS} ORDER BY {_sql}, l_orderkey, l_linenumber"


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, sf_dir):
    return limit_rows(sort_rows(_table(spark, sf_dir, "orders").scan(["o_orderkey", "o_totalprice"]), [SortKey("o_totalprice", ascending=False), SortKey("o_orderkey")]), 25)


@_query("SELECT o_orderkey FROM orders LIMIT 0")
def limit_zero(spark, sf_dir):
    return limit_rows(_table(spark, sf_dir, "orders").scan(["o_orderkey"]), 0)


@_query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus, file_row_number LIMIT 50".replace("orders ORDER", "(SELECT *, row_number() OVER () - 1 AS file_row_number FROM orders) ORDER"))
def sort_limit_ties(spark, sf_dir):
    """Ties keep the order of the file."""
    rows = _table(spark, sf_dir, "orders").scan_in_order(["o_orderkey", "o_orderstatus"])
    return limit_rows(sort_rows(rows, [SortKey("o_orderstatus")], ordinal=ParquetTable.ORDINALS), 50).select("o_orderkey", "o_orderstatus")


# -- statistics and workloads ------------------------------------------------------------


@_query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count(*) - count({c}) AS nulls, min({c})::DOUBLE + 0.0::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")))
def stats_analyze_lineitem(spark, sf_dir):
    names = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"]
    stats = analyze(_table(spark, sf_dir, "lineitem").scan(names))
    return spark.createDataFrame([(n, c.rows, c.nulls, float(c.min) + 0.0, float(c.max)) for n, c in stats.columns.items()], "name string, n long, nulls long, lo double, hi double")


STATISTICS = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"]
BOUNDS = " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count(*) - count({c}) AS nulls, min({c})::DOUBLE + 0.0::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM lineitem" for c in STATISTICS)


def _bounds(spark, stats) -> DataFrame:
    return spark.createDataFrame([(n, c.rows, c.nulls, float(c.min) + 0.0, float(c.max)) for n, c in stats.columns.items() if n in STATISTICS], "name string, n long, nulls long, lo double, hi double")


@_query(BOUNDS)
def stats_merge_parts(spark, sf_dir):
    """Three parts of lineitem, analyzed apart and merged."""
    df = _table(spark, sf_dir, "lineitem").scan(STATISTICS)
    return _bounds(spark, merge_all([analyze(df.filter(F.col("l_orderkey") % 3 == k)) for k in range(3)]))


@_query(BOUNDS)
def stats_footers(spark, sf_dir):
    """Statistics of lineitem from its footers alone."""
    return _bounds(spark, _table(spark, sf_dir, "lineitem").statistics())


@_query("SELECT 'o_orderstatus' AS name, count(DISTINCT o_orderstatus) AS n FROM orders UNION ALL SELECT 'c_nationkey', (SELECT count(DISTINCT c_nationkey) FROM customer) UNION ALL SELECT 'l_linenumber', (SELECT count(DISTINCT l_linenumber) FROM lineitem)")
def stats_approximate_distinct(spark, sf_dir):
    """Estimates that a sketch of 1,024 places gives to the nearest whole number for few values."""
    of = [("orders", "o_orderstatus"), ("customer", "c_nationkey"), ("lineitem", "l_linenumber")]
    return spark.createDataFrame([(c, round(analyze(_table(spark, sf_dir, t).scan([c])).columns[c].distinct)) for t, c in of], "name string, n long")


PREDICATES = {
    "l_quantity > 1e9": col("l_quantity") > lit(1e9),
    "l_quantity >= 1": col("l_quantity") >= lit(1.0),
    "l_partkey < 1": col("l_partkey") < lit(1),
    "l_discount = 0.05 AND l_partkey < 0": (col("l_discount") == lit(0.05)) & (col("l_partkey") < lit(0)),
    "l_partkey IS NULL": col("l_partkey").is_null(),
}


@_query(" UNION ALL ".join(f"SELECT '{t}' AS predicate, count(*) > 0 AS may FROM lineitem WHERE {t}" for t in PREDICATES))
def stats_may_match(spark, sf_dir):
    stats = analyze(_table(spark, sf_dir, "lineitem").scan(["l_quantity", "l_partkey", "l_discount"]))
    return spark.createDataFrame([(t, may_match(e, stats)) for t, e in PREDICATES.items()], "predicate string, may boolean")


@_query("SELECT 'less' AS name, round((5000.0 - min(o_totalprice)) / (max(o_totalprice) - min(o_totalprice)), 6)::DOUBLE AS share FROM orders UNION ALL SELECT 'both', round((100000.0 - min(o_totalprice)) / (max(o_totalprice) - min(o_totalprice)) * (1 - (50000.0 - min(o_totalprice)) / (max(o_totalprice) - min(o_totalprice))), 6)::DOUBLE FROM orders UNION ALL SELECT 'unknown', 0.5::DOUBLE UNION ALL SELECT 'none', 0.0::DOUBLE")
def stats_selectivity(spark, sf_dir):
    stats, price = analyze(_table(spark, sf_dir, "orders").scan(["o_orderkey", "o_totalprice"])), col("o_totalprice")
    of = {"less": price < lit(5000.0), "both": (price < lit(100000.0)) & (price > lit(50000.0)), "unknown": price + price > lit(7.0), "none": col("o_orderkey").is_null()}
    return spark.createDataFrame([(n, round(estimate_selectivity(e, stats), 6)) for n, e in of.items()], "name string, share double")


@_query(f"SELECT l_orderkey, {DAY.format('l_shipdate')} AS l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-12-01' AND l_shipdate < TIMESTAMP '1994-12-11' AND l_quantity < 24")
def filter_days_by_scan(spark, sf_dir):
    """Day numbers compared in a scan are tested on the stored timestamps."""
    return _table(spark, sf_dir, "lineitem").scan(["l_orderkey", "l_shipdate"], (col("l_shipdate") >= lit(9100)) & (col("l_shipdate") <= lit(9109)) & (col("l_quantity") < lit(24.0)))


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice < 50000 AND o_orderstatus = 'F' AND o_custkey > 3")
def filter_by_selectivity(spark, sf_dir):
    """Conjuncts tested from the most selective one on."""
    df = _table(spark, sf_dir, "orders").scan(["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"])
    wanted = (col("o_custkey") > lit(3)) & (col("o_totalprice") < lit(50000.0)) & (col("o_orderstatus") == lit("F"))
    return project(filter_rows(df, wanted, analyze(df)), _named("o_orderkey", "o_custkey"))


@_query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_smaller_side(spark, sf_dir):
    """The hash table is built from the side whose footers tell of fewer rows."""
    s, n = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    df = inner_join(s.scan(["s_suppkey", "s_nationkey"]), n.scan(["n_nationkey", "n_name"]), ["s_nationkey"], ["n_nationkey"], build="smaller", rows=(s.statistics().rows, n.statistics().rows))
    return project(df, _named("s_suppkey", "n_name"))


@_query("SELECT o_orderkey, c_name FROM orders JOIN (SELECT * FROM customer WHERE c_custkey < 0) ON o_custkey = c_custkey")
def join_empty_build(spark, sf_dir):
    none = _table(spark, sf_dir, "customer").scan(["c_custkey", "c_name"], col("c_custkey") < lit(0))
    return project(inner_join(_table(spark, sf_dir, "orders").scan(["o_orderkey", "o_custkey"]), none, ["o_custkey"], ["c_custkey"], build="right"), _named("o_orderkey", "c_name"))


@_query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 7 ORDER BY n_regionkey")
def memory_table(spark, sf_dir):
    """A table of three groups in memory, one of which the predicate skips; the sort is stable."""
    t = MemoryTable(spark, {"n_nationkey": Type.INT64, "n_name": Type.STRING, "n_regionkey": Type.INT64}, "nations")
    nations = _table(spark, sf_dir, "nation").scan(["n_nationkey", "n_name", "n_regionkey"])
    for lo, hi in ((0, 5), (5, 10), (10, 1000)):
        t.append(filter_rows(nations, (col("n_nationkey") >= lit(lo)) & (col("n_nationkey") < lit(hi))))
    rows = t.scan(predicate=col("n_nationkey") < lit(7), ordinal=True)
    return project(sort_rows(rows, [SortKey("n_regionkey")], ordinal=MemoryTable.ORDINAL), _named("n_nationkey", "n_name"))


@_query("SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def agg_in_small_batches(spark, sf_dir):
    """Planned and run with batches of 100 rows."""
    with ExecutionOptions(100).applied(spark):
        df = aggregate(_table(spark, sf_dir, "lineitem").scan(["l_linenumber"]), ["l_linenumber"], [Aggregate("n", "count")])
        return spark.createDataFrame(df.toArrow())  # seven rows


@_query(f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS count_order FROM lineitem WHERE {DAY.format('l_shipdate')} <= 9300 GROUP BY l_returnflag, l_linestatus")
def q1(spark, sf_dir):
    out = workloads.q1(workloads.of_days(_raw(spark, sf_dir, "lineitem"), "l_shipdate", "l_shipday", until=9301))
    return out.withColumns({c: F.round(c, 2) for c in ("sum_qty", "sum_base_price", "sum_disc_price")})


@_query(f"SELECT o_orderkey, {DAY.format('o_orderdate')} AS o_orderday, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' AND {DAY.format('o_orderdate')} < 9150 AND {DAY.format('l_shipdate')} > 9150 GROUP BY 1, 2 ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, 2, 1 LIMIT 10")
def q3(spark, sf_dir):
    orders = workloads.of_days(_raw(spark, sf_dir, "orders"), "o_orderdate", "o_orderday", until=9150)
    line = workloads.of_days(_raw(spark, sf_dir, "lineitem"), "l_shipdate", "l_shipday", 9151)
    return workloads.q3(_table(spark, sf_dir, "customer").scan(), orders, line).withColumn("revenue", F.round("revenue", 2))


@_query(f"SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE {DAY.format('l_shipdate')} >= 9100 AND {DAY.format('l_shipdate')} < 9200 AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24")
def q6(spark, sf_dir):
    line = workloads.of_days(_raw(spark, sf_dir, "lineitem"), "l_shipdate", "l_shipday", 9100, 9200)
    return workloads.q6(line, quantity=24.0).withColumn("revenue", F.round("revenue", 2))


@_query("SELECT i % 3 AS flag, count(*) AS n, CAST(sum(1 + i % 50) AS BIGINT) AS quantity FROM range(5000) t(i) GROUP BY 1")
def generate_lineitem(spark, sf_dir):
    """The generator's 5,000 lineitems, by flag."""
    line = workloads.generate(spark, 5000)["lineitem"]
    flag = F.expr("cast(array_position(array('R', 'A', 'N'), l_returnflag) - 1 as bigint)")
    return aggregate(line.withColumn("flag", flag), ["flag"], [Aggregate("n", "count"), Aggregate("quantity", "sum", "l_quantity")])
