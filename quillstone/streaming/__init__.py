"""The row-wise operators on Structured Streaming sources.

Expressions are the same on streams as on tables. Operators that need all rows (sorts,
limits, global aggregates) are left to batch queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillstone.functions.expr import Expr
from quillstone.functions.types import Schema
from quillstone.operators.relational import filter_rows, project


def parquet_stream(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """New Parquet files in a folder as a stream, with columns of the four types."""
    return spark.readStream.schema(T.StructType([T.StructField(n, t.spark) for n, t in schema.items()])).parquet(path)


def filter_stream(stream: DataFrame, predicate: Expr) -> DataFrame:
    return filter_rows(stream, predicate)


def project_stream(stream: DataFrame, outputs) -> DataFrame:
    return project(stream, outputs)
