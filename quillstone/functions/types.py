"""The four column types and strict schema checks."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Type(Enum):
    """Nothing is cast implicitly between these."""

    BOOLEAN = "boolean"
    INT64 = "bigint"
    DOUBLE = "double"
    STRING = "string"

    @property
    def spark(self) -> T.DataType:
        return {"boolean": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}[self.value]

    @property
    def numeric(self) -> bool:
        return self in (Type.INT64, Type.DOUBLE)


Schema = dict[str, Type]  #: column names in order

INT64_MIN, INT64_MAX = -(1 << 63), (1 << 63) - 1


def type_of_spark(kind: T.DataType) -> Type | None:
    return {"boolean": Type.BOOLEAN, "bigint": Type.INT64, "double": Type.DOUBLE, "string": Type.STRING}.get(kind.simpleString())


def type_of_value(value) -> Type:
    if isinstance(value, bool):
        return Type.BOOLEAN
    if isinstance(value, int):
        if not INT64_MIN <= value <= INT64_MAX:
            raise ValueError(f"{value} is no 64-bit integer")
        return Type.INT64
    if isinstance(value, float):
        return Type.DOUBLE
    if isinstance(value, str):
        return Type.STRING
    raise TypeError(f"no column type holds {value!r}; a null needs its type: null_literal(type)")


def unique(names) -> None:
    seen = set()
    for n in names:
        if n in seen:
            raise ValueError(f"duplicate column {n}")
        seen.add(n)


def schema_of(df: DataFrame) -> dict[str, Type | None]:
    """Types by column name; None for columns of other types, which no expression may use."""
    unique(df.columns)
    return {f.name: type_of_spark(f.dataType) for f in df.schema.fields}


def strict(df: DataFrame) -> DataFrame:
    """df, if all its columns are of the four types."""
    for name, kind in schema_of(df).items():
        if kind is None:
            raise TypeError(f"unsupported column type: {name} {df.schema[name].dataType.simpleString()}")
    return df


def column_type(schema, name: str) -> Type:
    if name not in schema:
        raise ValueError(f"unknown column {name}")
    if schema[name] is None:
        raise TypeError(f"column {name} is of an unsupported type")
    return schema[name]
