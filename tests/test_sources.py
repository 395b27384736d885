import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException

from quillstone.functions import Type, binary, col, lit
from quillstone.functions.expr import FLIPPED
from quillstone.operators import Aggregate, SortKey, aggregate, filter_rows, sort_rows
from quillstone.plans.explain import explain, scan_metrics
from quillstone.sources import MemoryTable, ParquetTable
from quillstone.streaming import filter_stream, parquet_stream


def table():
    rows = range(12)
    return pa.table(
        {
            "id": pa.array([i if i < 8 else None for i in rows], pa.int64()),
            "value": pa.array([float("nan") if i == 2 else float(i) for i in rows]),
            "label": pa.array([None if i == 1 else f"row{i}" for i in rows]),
            "flag": pa.array([i % 2 == 0 for i in rows]),
        }
    )


@pytest.fixture(params=[True, False], ids=["statistics", "none"])
def path(request, tmp_path):
    at = str(tmp_path / "t.parquet")
    pq.write_table(table(), at, row_group_size=4, write_statistics=request.param)
    return at


def test_parquet(spark, path):
    t = ParquetTable(spark, path)
    assert t.schema == {"id": Type.INT64, "value": Type.DOUBLE, "label": Type.STRING, "flag": Type.BOOLEAN}
    assert [tuple(r) for r in t.scan(["label", "id"], col("id") < lit(3)).collect()] == [("row0", 0), (None, 1), ("row2", 2)]
    assert aggregate(t.scan([]), [], [Aggregate("n", "count")]).first()["n"] == 12
    assert t.scan(["id"], col("id") > lit(100)).count() == 0
    assert t.scan(["id"], col("id").is_null()).count() == 4
    assert t.scan(["value"], col("value") != col("value")).count() == 1
    assert t.scan(["value"], col("value") > lit(9.0)).count() == 2
    assert t.scan(["value"], ~(col("value") <= lit(9.0))).count() == 3


def test_pushdown_and_pruning(spark, tmp_path):
    at = str(tmp_path / "t.parquet")
    pq.write_table(table(), at, row_group_size=4)
    df = ParquetTable(spark, at).scan(["label"], (col("id") < lit(3)) & (col("value") > lit(-1.0)))
    plan = explain(df)
    assert "LessThan(id,3)" in plan and "GreaterThan(value,-1.0)" in plan and "flag" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert scan_metrics(ParquetTable(spark, at).scan(["label"], col("id") < lit(3)))["numOutputRows"] == 4


def test_empty_and_missing_files(spark, tmp_path):
    at = str(tmp_path / "e.parquet")
    pq.write_table(table().slice(0, 0), at)
    assert ParquetTable(spark, at).scan().count() == 0
    with pytest.raises(AnalysisException):
        ParquetTable(spark, str(tmp_path / "none.parquet"))


def test_unsupported_types(spark, tmp_path):
    at = str(tmp_path / "u.parquet")
    pq.write_table(pa.table({"i": pa.array([1], pa.int32()), "l": pa.array([[1.0]])}), at)
    with pytest.raises(TypeError):
        ParquetTable(spark, at)
    loose = ParquetTable(spark, at, strict_types=False)
    assert loose.schema == {"i": Type.INT64} and loose.scan().first()["i"] == 1


def test_file_order(spark, path):
    t = ParquetTable(spark, path)
    got = sort_rows(t.scan_in_order(["label", "flag"]), [SortKey("flag")], ordinal="__position").select("label")
    assert [r[0] for r in got.collect()] == [None, "row3", "row5", "row7", "row9", "row11", "row0", "row2", "row4", "row6", "row8", "row10"]


def test_stable_sort_over_files(spark, tmp_path):
    for n, rows in enumerate(([(2, "a"), (1, "b"), (2, "c")], [(1, "d"), (2, "e"), (1, "f")])):
        pq.write_table(pa.table({"k": pa.array([k for k, _ in rows], pa.int32()), "v": [v for _, v in rows]}), str(tmp_path / f"{n}.parquet"))
    t = ParquetTable(spark, str(tmp_path), strict_types=False)
    rows = t.scan_in_order(["k", "v"])
    assert dict(rows.dtypes)["k"] == "bigint" == dict(t.scan().dtypes)["k"]
    assert "".join(r["v"] for r in sort_rows(rows, [SortKey("k")], ordinal=ParquetTable.ORDINALS).collect()) == "bdface"
    with pytest.raises(ValueError):
        t.scan_in_order(["none"])


def test_footer_statistics(spark, path, tmp_path):
    t = ParquetTable(spark, path)
    told = t.statistics().columns["id"].max is not None
    groups = t.group_statistics()
    assert [g.rows for g in groups] == [4, 4, 4] and t.statistics().rows == 12
    if told:
        x = t.statistics().columns
        assert (x["id"].min, x["id"].max, x["id"].nulls, x["label"].nulls, x["label"].max) == (0, 7, 4, 1, "row9") and x["value"].has_nan
        assert t.groups(col("id") < lit(3)) == (1, 2) and t.groups(col("id").is_null()) == (1, 2)
    else:
        assert t.groups(col("id") < lit(3)) == (3, 0)
    assert t.groups(None) == (3, 0)


def test_days_reach_the_reader(spark, tmp_path):
    import datetime

    at, epoch = str(tmp_path / "d.parquet"), datetime.datetime(1970, 1, 1)
    stamps = [epoch + datetime.timedelta(days=d, hours=h) for d in (9099, 9100, 9105) for h in (0, 23)] + [None]
    pq.write_table(pa.table({"ts": pa.array(stamps, pa.timestamp("us")), "day": pa.array([s and s.date() for s in stamps], pa.date32())}), at)
    t = ParquetTable(spark, at, strict_types=False)
    for c in ("ts", "day"):
        for op, n in (("<", 2), ("<=", 4), (">", 2), (">=", 4), ("=", 2), ("!=", 4)):
            for e in (binary(op, col(c), lit(9100)), binary(FLIPPED[op], lit(9100), col(c))):
                assert t.scan([c], e).count() == n
        assert f"LessThan({c}" in explain(t.scan([c], col(c) < lit(9100)))


def test_memory_table_keeps_frames_and_skips_groups(spark):
    t = MemoryTable(spark, {"x": Type.INT64})
    t.append(spark.range(10).withColumnRenamed("id", "y")).append([(100,), (101,)]).append(spark.range(200, 205).toDF("z")).append(spark.range(0).toDF("z"))
    assert t.rows == 17 and t.statistics().columns["x"].max == 204
    assert t.scan(["x"], col("x") > lit(100)).count() == 6 and (t.groups_read, t.groups_skipped) == (2, 1)
    assert [r["x"] for r in sort_rows(t.scan(ordinal=True), [], ordinal=MemoryTable.ORDINAL).collect()] == [*range(10), 100, 101, *range(200, 205)]
    assert t.scan(["x"], col("x") > lit(1000)).count() == 0 and t.groups_read == 0


def test_memory_table(spark):
    t = MemoryTable(spark, {"x": Type.INT64, "s": Type.STRING}, "things")
    assert t.scan().count() == 0
    t.append([]).append([(1, "a"), (None, None)]).append(spark.createDataFrame([(3, "c")], "a bigint, b string"))
    assert sorted(t.scan(["s", "x"]).collect(), key=repr) == sorted([("a", 1), (None, None), ("c", 3)], key=repr)
    assert t.scan(["x"], col("x") > lit(1)).collect() == [(3,)]
    for bad in ([(1,)], [("a", "b")], [(1.0, "a")], [(True, "a")]):
        with pytest.raises(ValueError):
            t.append(bad)
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(1.0, "c")], "a double, b string"))
    with pytest.raises(ValueError):
        t.scan(["none"])
    with pytest.raises(ValueError):
        t.scan(["x", "x"])
    t.register()
    assert spark.sql("select count(*) from things").first()[0] == 3
    assert next(t.scan(["x"]).toLocalIterator())["x"] == 1


def test_stream(spark, tmp_path):
    pq.write_table(table(), str(tmp_path / "part.parquet"))
    stream = filter_stream(parquet_stream(spark, str(tmp_path), {"id": Type.INT64, "value": Type.DOUBLE}), col("id") < lit(3))
    q = stream.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select id from streamed order by id").collect() == [(0,), (1,), (2,)]
    assert filter_rows(spark.table("streamed"), col("value") != col("value")).count() == 1
