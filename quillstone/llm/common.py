"""Shared helpers: tables, the shared folder, memory of Python workers and Arrow row emission."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may leave it unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Spark's setting to remove a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and reread it: cuts the lineage and survives lost executors.

    What comes after reads the table, so the shuffle files behind it go once it stands.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    _paths.append(path)
    return out


_paths: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _paths:
        _paths.remove(path)


def forget(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.table_path)


def tables_so_far() -> int:
    return len(_paths)


def forget_since(mark: int, keep: DataFrame) -> None:
    """Removes what written() has made since then and is still there, but for one table: what led to it is read no more."""
    for path in _paths[mark:]:
        if path != keep.table_path:
            _delete(keep.sparkSession, path)


#: Bytes of texts that go to a Python worker at once, unless the session says otherwise.
BATCH_BYTES = 4 << 20
_BATCHES, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Texts reach Python in batches of BATCH_BYTES: at Spark's own bound every task holds 64 MB several times over.

    Results do not depend on it; a session that has set its own bound keeps it.
    """
    if spark.conf.get(_BATCHES) == _SPARKS_OWN:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


_held: dict = {}


def resident(key, make):
    """An object that a worker process keeps between tasks: make()'s, for the last key asked for. Others go."""
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]


def light(batches, keeping: bool = False):
    """Passes batches on; what earlier operators kept goes first unless keeping, and what a task has freed goes to the system after."""
    if not keeping:
        _held.clear()
    yield from batches
    release(collect=not keeping)


def release(collect: bool = True) -> None:
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def row_ids():
    """Numbers that are unique over the tasks of one stage; only fixed once written."""
    part = TaskContext.get().partitionId()
    n = part << 40
    while True:
        yield n
        n += 1


def id_texts(batch: pa.RecordBatch) -> tuple[list, list]:
    return batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]


def slices(texts: list, most: int):
    """(from, to) ranges of texts with about `most` code points each; a longer text stands alone."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield lo, i
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keep_rows(df: DataFrame, text_col: str, test) -> DataFrame:
    """Rows of df whose text passes test(texts) -> booleans; null texts are given as empty.

    Columns are passed on by place, whatever their names.
    """
    at = df.columns.index(text_col)
    small_batches(df.sparkSession)

    def keep(batches):
        for batch in light(batches):
            yield batch.filter(pa.array(test([t or "" for t in batch.column(at).to_pylist()]), pa.bool_()))

    return df.mapInArrow(keep, df.schema)
