"""Execution options, as settings of the session for a while."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class ExecutionOptions:
    """batch_size: rows in a batch of the columnar readers, 1 to 65,535."""

    batch_size: int = 2048

    def __post_init__(self):
        if not 1 <= self.batch_size <= 65_535:
            raise ValueError("a batch holds 1 to 65535 rows")

    @contextmanager
    def applied(self, spark: SparkSession):
        """Within it, what is planned reads Parquet and cached tables in such batches."""
        keys = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.inMemoryColumnarStorage.batchSize")
        before = {k: spark.conf.get(k) for k in keys}
        for k in keys:
            spark.conf.set(k, str(self.batch_size))
        try:
            yield
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
