"""The bytes of rows, by their types and values: what decides whether a side of a join is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def width(column: Column, kind: T.DataType) -> Column:
    """The bytes of a value."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(column, F.lit(0), lambda n, x: n + width(x, kind.elementType).cast("int")), F.lit(0)) + 16
        return F.coalesce(F.greatest(F.size(column), F.lit(0)) * 8, F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        total = F.lit(8)
        for f in kind.fields:
            total = total + width(column[f.name], f.dataType)
        return total
    return F.lit(8)


def held_bytes(df: DataFrame) -> int:
    """The bytes of all rows, by one aggregation."""
    total = F.lit(8).cast("long")
    for f in df.schema.fields:
        total = total + width(df[f"`{f.name}`"], f.dataType)
    return df.agg(F.sum(total)).first()[0] or 0
