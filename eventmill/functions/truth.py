"""Truthiness of a column: NULL, zero, empty text and empty collections count as nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truthy(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType, T.BinaryType)):
        some = F.length(column) > 0
    elif isinstance(data_type, (T.ArrayType, T.MapType)):
        some = F.size(column) > 0
    elif isinstance(data_type, T.BooleanType):
        some = column
    elif isinstance(data_type, T.NumericType):
        some = column != 0
    elif isinstance(data_type, T.VariantType):
        some = ~F.to_json(column).isin("null", "false", "0", "0.0", '""', "[]", "{}")
    else:
        some = F.lit(True)
    return column.isNotNull() & F.coalesce(some, F.lit(False))
