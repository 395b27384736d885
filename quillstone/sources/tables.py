"""Sources: in-memory tables and Parquet files, and what a scan of them reads."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.expr import FLIPPED, Binary, Col, Expr, Lit, conjuncts, expression_type, simplify
from quillstone.functions.types import Schema, Type, column_type, schema_of, strict, type_of_spark, unique
from quillstone.operators.relational import filter_rows
from quillstone.plans.statistics import ColumnStatistics, Statistics, analyze, may_match, merge_all


class MemoryTable:
    """An append-only table of a fixed schema, held by Spark. `ordinal` names a hidden input position."""

    ORDINAL = "__position"

    def __init__(self, spark: SparkSession, schema: Schema, name: str = "memory"):
        unique(schema)
        self.spark, self.schema, self.name = spark, dict(schema), name
        self._fields = [T.StructField(n, t.spark) for n, t in schema.items()]
        self._parts: list[DataFrame] = []
        self._stats: list[Statistics | None] = []
        self.rows = self._next = self.groups_read = self.groups_skipped = 0

    def append(self, batch: list[tuple] | DataFrame) -> MemoryTable:
        """Adds rows as one group; ValueError for other widths or types, empty batches add nothing.

        A DataFrame stays where it is: Spark caches it and numbers its rows.
        """
        fields = T.StructType([*self._fields, T.StructField(self.ORDINAL, T.LongType())])
        if isinstance(batch, DataFrame):
            if [f.dataType for f in batch.schema.fields] != [f.dataType for f in self._fields]:
                raise ValueError("the batch has other columns than the table")
            numbered = batch.toDF(*self.schema).withColumn(self.ORDINAL, F.lit(self._next) + F.monotonically_increasing_id()).persist()
            n, last = numbered.agg(F.count("*"), F.max(self.ORDINAL)).first()
            if n:
                self._add(numbered, n, last + 1)
            return self
        for row in batch:
            if len(row) != len(self._fields):
                raise ValueError("the batch has another width than the table")
            for v, t in zip(row, self.schema.values()):
                if v is not None and type(v) is not {Type.BOOLEAN: bool, Type.INT64: int, Type.DOUBLE: float, Type.STRING: str}[t]:
                    raise ValueError(f"{v!r} is no {t.value}")
        if batch:
            self._add(self.spark.createDataFrame([(*row, self._next + i) for i, row in enumerate(batch)], fields), len(batch), self._next + len(batch))
        return self

    def _add(self, part: DataFrame, rows: int, after: int) -> None:
        self._parts.append(part)
        self._stats.append(None)
        self.rows += rows
        self._next = after

    def group_statistics(self) -> list[Statistics]:
        """Of each group; read once, when first asked for."""
        self._stats = [s or analyze(p.drop(self.ORDINAL)) for s, p in zip(self._stats, self._parts)]
        return self._stats

    def statistics(self) -> Statistics:
        if not self._parts:
            return analyze(self.scan())
        return merge_all(self.group_statistics())

    def scan(self, columns: list[str] | None = None, predicate: Expr | None = None, ordinal: bool = False) -> DataFrame:
        """The table, or columns of it in the order asked; groups that cannot match predicate are skipped, and it is applied.

        groups_read and groups_skipped tell of the last scan.
        """
        parts = self._parts
        if predicate is not None:
            parts = [p for p, s in zip(parts, self.group_statistics()) if may_match(simplify(predicate), s)]
        self.groups_read, self.groups_skipped = len(parts), len(self._parts) - len(parts)
        empty = self.spark.createDataFrame([], T.StructType([*self._fields, T.StructField(self.ORDINAL, T.LongType())]))
        df = reduce(DataFrame.unionAll, parts) if parts else empty
        return _scan(df, columns if columns is not None else list(self.schema), predicate, [self.ORDINAL] if ordinal else [])

    def register(self) -> None:
        self.scan().createOrReplaceTempView(self.name)


class ParquetTable:
    """Parquet at a path or paths: files or folders, in any store Spark reads.

    strict: only the four types are taken. Otherwise 32-bit and smaller integers, floats
    and dates (as day numbers since 1970-01-01) are widened and other columns left out.
    """

    ORDINALS = ("__file", "__position")

    def __init__(self, spark: SparkSession, *paths: str, strict_types: bool = True):
        self.df = spark.read.parquet(*paths)
        self.frame = strict(self.df) if strict_types else widened(self.df)

    @property
    def schema(self) -> Schema:
        return schema_of(self.frame)

    def scan(self, columns: list[str] | None = None, predicate: Expr | None = None) -> DataFrame:
        """Only the columns asked for are decoded; predicate reaches the reader and is applied.

        Comparisons of a day number with a literal are tested on the stored date or timestamp,
        so that they reach the reader as well.
        """
        columns = columns if columns is not None else self.frame.columns
        if predicate is None or expression_type(predicate, self.schema) is not Type.BOOLEAN:
            return _scan(self.frame, columns, predicate, [])
        raw, rest = self.df, []
        for c in conjuncts(simplify(predicate)):
            test = self._on_stored_day(c)
            if test is None:
                rest.append(c)
            else:
                raw = raw.filter(test)
        kept = raw.select(self.frame.columns) if self.frame is self.df else widened(raw)
        return _scan(kept, columns, reduce(lambda a, b: a & b, rest) if rest else None, [])

    def _on_stored_day(self, e: Expr) -> Column | None:
        """A comparison of a widened day with a literal, as one of the column that is stored; else None."""
        match e:
            case Binary(op, Col(name), Lit(day, Type.INT64)) if op in FLIPPED:
                pass
            case Binary(op, Lit(day, Type.INT64), Col(name)) if op in FLIPPED:
                op = FLIPPED[op]
            case _:
                return None
        if name not in self.df.columns or day is None or self.df.schema[name].dataType.simpleString() not in ("date", "timestamp", "timestamp_ntz") or not -700_000 < day < 2_900_000:
            return None
        c = F.col(f"`{name}`")
        at = lambda d: F.lit((datetime.date(1970, 1, 1) + datetime.timedelta(days=d)).isoformat()).cast(self.df.schema[name].dataType)
        return {"<": lambda: c < at(day), "<=": lambda: c < at(day + 1), ">": lambda: c >= at(day + 1), ">=": lambda: c >= at(day), "=": lambda: (c >= at(day)) & (c < at(day + 1)), "!=": lambda: (c < at(day)) | (c >= at(day + 1))}[op]()

    def scan_in_order(self, columns: list[str] | None = None) -> DataFrame:
        """As scan, with the input position of each row as __file and __position (ORDINALS) for stable sorts."""
        columns = columns if columns is not None else self.frame.columns
        unique(columns)
        for c in columns:
            column_type(self.schema, c)
        own = {c: _widened(self.df.schema[c]) for c in columns}
        return self.df.select(*(own[c].alias(c) for c in columns), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__position"))

    def group_statistics(self) -> list[Statistics]:
        """Of each row group, from the footers, which the driver reads: one small read for a file.

        Footers tell no distinct values and leave NaN out of bounds, so doubles may hold it.
        Columns without footer statistics, or of stored types that are widened, have no bounds.
        """
        jvm, conf = self.df.sparkSession._jvm, self.df.sparkSession._jsc.hadoopConfiguration()
        kinds, out = self.schema, []
        for file in sorted(self.df.inputFiles()):
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf))
            try:
                for block in reader.getFooter().getBlocks():
                    n, columns = block.getRowCount(), {}
                    for chunk in block.getColumns():
                        name, stats = chunk.getPath().toDotString(), chunk.getStatistics()
                        if name not in kinds:
                            continue
                        as_is = stats is not None and type_of_spark(self.df.schema[name].dataType) is kinds[name]
                        bound = (lambda v: v.toStringUsingUTF8()) if kinds[name] is Type.STRING else (lambda v: v)
                        valued = as_is and stats.hasNonNullValue()
                        known = stats is not None and stats.isNumNullsSet()
                        columns[name] = ColumnStatistics(kinds[name], n, stats.getNumNulls() if known else 0, kinds[name] is Type.DOUBLE, bound(stats.genericGetMin()) if valued else None, bound(stats.genericGetMax()) if valued else None, nulls_known=known)
                    out.append(Statistics(n, columns))
            finally:
                reader.close()
        return out

    def statistics(self) -> Statistics:
        """Of the whole table, from the footers."""
        groups = self.group_statistics()
        return merge_all(groups) if groups else analyze(self.frame)

    def groups(self, predicate: Expr | None) -> tuple[int, int]:
        """Row groups that predicate may match, and those it skips."""
        may = [may_match(simplify(predicate) if predicate is not None else None, s) for s in self.group_statistics()]
        return sum(may), len(may) - sum(may)


def _scan(df: DataFrame, columns: list[str], predicate: Expr | None, more: list[str]) -> DataFrame:
    unique(columns)
    schema = schema_of(df)
    for c in columns:
        column_type(schema, c)
    if predicate is not None:
        df = filter_rows(df, predicate)
    return df.select(*columns, *more)


def _widened(f: T.StructField) -> Column | None:
    """A column of a narrower type as the nearest of the four; None for others."""
    c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
    if kind in ("boolean", "bigint", "double", "string"):
        return c
    if kind in ("tinyint", "smallint", "int"):
        return c.cast("long").alias(f.name)
    if kind == "float":
        return c.cast("double").alias(f.name)
    return F.unix_date(c.cast("date")).cast("long").alias(f.name) if kind in ("date", "timestamp", "timestamp_ntz") else None


def widened(df: DataFrame) -> DataFrame:
    """Columns of narrower types as the nearest of the four; others are dropped."""
    return df.select([c for c in map(_widened, df.schema.fields) if c is not None])
