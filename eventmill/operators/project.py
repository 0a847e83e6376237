"""Projections of records to flat columns or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.functions.json_text import record_text
from eventmill.functions.once import computed
from eventmill.functions.paths import event_field
from eventmill.functions.truth import truthy
from eventmill.operators.parse import parse_events


def select_fields(df: DataFrame, fields: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """One column per path, named like the path; missing values are NULL."""
    types = types or {}
    return df.select(*[event_field(df, path, types.get(path, "string")).alias(path) for path in fields])


def json_select(df: DataFrame, fields: list[str], column: str = "text") -> DataFrame:
    """The listed top-level values that are present, joined by blanks; an empty line when none is."""
    return df.withColumn(column, F.concat_ws(" ", *[_printed(F.col("rec")[name]) for name in fields]))


def json_select_lines(df: DataFrame, fields: list[str], column: str = "value") -> DataFrame:
    """The same for lines of text: lines that are no JSON object go, one without any of the fields, `{}` too, is an empty line."""
    return json_select(parse_events(df, column, keep_empty=True), fields, column).drop("rec")


def _printed(value: Column) -> Column:
    text = record_text(value)
    return (
        F.when(text.startswith('"'), F.try_variant_get(value, "$", "string"))
        .when(text == "null", F.lit("None"))
        .when(text == "true", F.lit("True"))
        .when(text == "false", F.lit("False"))
        .otherwise(text)
    )


def map_keep_truthy(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Apply an expression to every row and keep the rows where it gives something."""
    mapped = computed(df, name, column)
    return mapped.where(truthy(F.col(name), mapped.schema[name].dataType))
