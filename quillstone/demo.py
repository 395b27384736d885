"""python -m quillstone.demo [q1|q3|q6] [rows]: a workload over generated tables, with its plan and time."""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans import workloads
from quillstone.plans.explain import explain, memory_metrics


def plan(spark: SparkSession, query: str = "q6", rows: int = 100_000) -> DataFrame:
    t = workloads.generate(spark, rows)
    if query == "q1":
        return workloads.q1(t["lineitem"])
    if query == "q3":
        return workloads.q3(t["customer"], t["orders"], t["lineitem"])
    if query == "q6":
        return workloads.q6(t["lineitem"])
    raise ValueError("usage: python -m quillstone.demo [q1|q3|q6] [rows]")


def main(arguments: list[str]) -> int:
    spark = SparkSession.builder.appName("demo").getOrCreate()
    try:
        df = plan(spark, *arguments[:1], *map(int, arguments[1:2]))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    print(explain(df))
    began = time.perf_counter()
    found = df.collect()
    took = time.perf_counter() - began
    print(*df.columns, sep="\t")
    for row in found:
        print(*row, sep="\t")
    print(f"execution_ms={took * 1000:.3f} held_bytes={memory_metrics(df).get('peakMemory', 0)}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
