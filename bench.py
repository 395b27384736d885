"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; its seconds are the median. Results
go to a sink that reads every row and column and keeps none. The test files are of one row
group, which one task reads, so that most of these seconds are the fixed cost of a job:
`slope` times q1, q3 and q6 and two simple queries once more over the tables read TIMES times
(lineitem, with orders and customer as they are), and gives the rows a second that more
rows take.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

TIMES = 60
QUERIES = ("filter_int_range", "filter_double_range", "agg_group_single", "agg_group_composite", "agg_group_null_key", "join_inner_single", "join_inner_composite", "join_three_way", "topk", "q1", "q3", "q6")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from quillstone.functions import col, lit
    from quillstone.operators import Aggregate, aggregate, filter_rows
    from quillstone.plans import workloads
    from quillstone.plans.catalog import QUERIES as own
    from quillstone.sources import ParquetTable, widened

    def seconds(query) -> float:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        return round(statistics.median(times[1:]), 4)

    took = {name: seconds(lambda: own[name](spark, sf_dir)) for name in QUERIES}  # noqa: B023
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    rates = {q: round(rows / took[q] / 1e6, 2) for q in ("q1", "q3", "q6")}

    def over(n: int) -> dict:
        """The same plans with lineitem read n times."""
        raw = lambda: spark.read.parquet(*[f"{sf_dir}/lineitem.parquet"] * n)
        line = lambda first=None, until=None: workloads.of_days(raw(), "l_shipdate", "l_shipday", first, until)
        orders = lambda: workloads.of_days(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", "o_orderday", until=9150)
        customer = lambda: ParquetTable(spark, f"{sf_dir}/customer.parquet", strict_types=False).scan()
        return {
            "q1": lambda: workloads.q1(line(until=9301)),
            "q3": lambda: workloads.q3(customer(), orders(), line(9151)),
            "q6": lambda: workloads.q6(line(9100, 9200), quantity=24.0),
            "filter": lambda: filter_rows(widened(raw()).select("l_orderkey", "l_discount"), col("l_discount") >= lit(0.05)),
            "group": lambda: aggregate(widened(raw()).select("l_suppkey", "l_partkey"), ["l_suppkey"], [Aggregate("s", "sum", "l_partkey")]),
        }

    slope = {}
    for name, query in over(TIMES).items():
        more = seconds(query) - seconds(over(1)[name])
        slope[name] = round((TIMES - 1) * rows / more / 1e6, 2) if more > 0.05 else None
    print(json.dumps({"metric": "total of the median seconds of the headline queries", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2], "lineitems": rows, "million_lineitems_per_sec": rates, "slope_million_lineitems_per_sec": slope}))
    spark.stop()


if __name__ == "__main__":
    main()
