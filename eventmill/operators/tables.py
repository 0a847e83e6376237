"""Typed tables from text, and canned SQL over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.functions.typed import clean_header, parse_dollars, parse_float, parse_int

_PARSERS = {"int": parse_int, "float": parse_float, "dollars": parse_dollars}


def clean_column_names(df: DataFrame) -> DataFrame:
    """Column names made of letters, digits and single underscores."""
    return df.toDF(*[clean_header(name) for name in df.columns])


def available_fields(df: DataFrame) -> list[str]:
    return df.columns


def parse_typed_columns(df: DataFrame, kinds: dict[str, str], lenient: bool = False) -> DataFrame:
    """Columns of kind `int`, `float` or `dollars` become numbers; all others stay text, empty when missing."""

    def typed(name: str):
        column = F.col(f"`{name}`")
        if name in kinds:
            return _PARSERS[kinds[name]](column, lenient).alias(name)
        return F.coalesce(column, F.lit("")).alias(name)

    return df.select(*[typed(name) for name in df.columns])
