import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from quillstone import demo
from quillstone.functions import col, lit
from quillstone.operators import Aggregate, SortKey, aggregate, filter_rows, limit_rows, sort_rows
from quillstone.plans import catalog, workloads
from quillstone.plans.explain import estimated_rows, explain, memory_metrics, output_schema
from quillstone.plans.options import ExecutionOptions
from quillstone.plans.statistics import analyze

SMALL = "/root/testdata/sf0.001"


def test_generated_workloads(spark):
    t = workloads.generate(spark, 5000)
    assert [t[n].count() for n in ("lineitem", "orders", "customer")] == [5000, 1250, 125]
    line = [r.asDict() for r in t["lineitem"].collect()]
    want = sum(r["l_extendedprice"] * r["l_discount"] for r in line if 9100 <= r["l_shipday"] < 9200 and 0.05 <= r["l_discount"] <= 0.07 and r["l_quantity"] < 24)
    assert workloads.q6(t["lineitem"]).first()["revenue"] == pytest.approx(want, rel=1e-9)
    groups = {}
    for r in line:
        if r["l_shipday"] <= 9300:
            g = groups.setdefault((r["l_returnflag"], r["l_linestatus"]), [0, 0.0, 0.0, 0])
            for k, v in enumerate((r["l_quantity"], r["l_extendedprice"], r["l_extendedprice"] * (1 - r["l_discount"]), 1)):
                g[k] += v
    got = workloads.q1(t["lineitem"]).collect()
    assert [tuple(r)[:2] for r in got] == sorted(groups)
    for r in got:
        assert list(r)[2:] == pytest.approx(groups[tuple(r)[:2]], rel=1e-9)
    top = workloads.q3(t["customer"], t["orders"], t["lineitem"]).collect()
    assert len(top) == 10 and [r["revenue"] for r in top] == sorted((r["revenue"] for r in top), reverse=True)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_pushdown_of_days(spark):
    plan = explain(catalog.q6(spark, SMALL))
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_quantity,24.0)" in plan
    assert "l_comment" not in plan and "l_returnflag" not in plan


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_every_query_of_the_engine_has_sql_and_agrees(spark):
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) <= set(entry_points.queries())
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    for name, query in catalog.QUERIES.items():
        df = query(spark, SMALL)
        cols = sorted(df.columns)
        sql = con.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in sql.description]
        assert sorted(names) == cols, name
        zero = lambda v: v + 0.0 if isinstance(v, float) else v
        want = sorted(repr([zero(r[names.index(c)]) for c in cols]) for r in sql.fetchall())
        assert sorted(repr([zero(r[c]) for c in cols]) for r in df.collect()) == want, name


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_introspection(spark):
    df = workloads.generate(spark, 100)["orders"]
    assert list(output_schema(df)) == ["o_orderkey", "o_custkey", "o_orderday"]
    assert estimated_rows(df) == 25
    assert estimated_rows(filter_rows(df, col("o_orderday") < lit(9100))) == 12.5
    assert estimated_rows(aggregate(df, ["o_custkey"], [Aggregate("n", "count")])) == 5
    assert estimated_rows(aggregate(df, [], [Aggregate("n", "count")])) == 1
    assert estimated_rows(limit_rows(df, 3)) == 3
    # with the table's statistics: uniform values between bounds, distinct values of keys
    stats = analyze(df)
    assert estimated_rows(aggregate(df, ["o_custkey"], [Aggregate("n", "count")]), stats=stats) == pytest.approx(2, abs=0.01)
    few = filter_rows(df, col("o_orderday") < lit(9006))
    assert estimated_rows(few, stats=stats) == pytest.approx(25 * 6 / 24)
    assert estimated_rows(aggregate(few, ["o_custkey"], []), stats=stats) == pytest.approx(2, abs=0.01)
    assert estimated_rows(limit_rows(few, 3), stats=stats) == 3
    assert estimated_rows(aggregate(aggregate(df, ["o_orderkey"], [Aggregate("n", "count")]), ["n"], []), stats=stats) == pytest.approx(25**0.5, abs=0.1)
    assert memory_metrics(sort_rows(df, [SortKey("o_custkey")]))["peakMemory"] > 0


def test_demo(spark):
    assert [demo.plan(spark, q, 5000).count() for q in ("q1", "q3", "q6")] == [6, 10, 1]
    with pytest.raises(ValueError):
        demo.plan(spark, "q2")


def test_options(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    with ExecutionOptions(7).applied(spark):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before
    for bad in (0, 65_536):
        with pytest.raises(ValueError):
            ExecutionOptions(bad)


def test_entry_points_without_the_training_part(monkeypatch):
    import builtins

    real = builtins.__import__

    def fail(name, *a, **kw):
        if name.startswith(("quillstone.llm", "corpus_pipeline", "public_tokenizers")):
            raise ImportError(name)
        return real(name, *a, **kw)

    monkeypatch.setattr(builtins, "__import__", fail)
    assert set(entry_points.queries()) == set(catalog.QUERIES) and set(entry_points.oracle_sql()) == set(catalog.ORACLE_SQL)
