"""Row filters. All are stateless, so they run on streams as well."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.functions.paths import event_field

# Spellings tried for a cut-off date given by a person.
DATE_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y/%m/%d", "%d %b %Y", "%b %d %Y", "%b %d, %Y", "%d %B %Y", "%B %d %Y", "%B %d, %Y", "%m/%d/%Y"]


def filter_data(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def select_in(df: DataFrame, text: str, column: str = "value") -> DataFrame:
    """Lines in which the text occurs; use it before parsing."""
    return df.where(F.col(column).contains(text))


def parse_cutoff(date: str) -> datetime:
    """One free-form date on the driver."""
    try:
        return datetime.fromisoformat(date.strip())
    except ValueError:
        pass
    for spelling in DATE_FORMATS:
        try:
            return datetime.strptime(date.strip(), spelling)
        except ValueError:
            continue
    raise ValueError(f"not a date: {date}")


def date_gt(df: DataFrame, date: str | None, path: str = "time") -> DataFrame:
    """Events strictly after the date; no date, no filter. Times without zone count as the session's."""
    if not date:
        return df
    cutoff = parse_cutoff(date)
    time = event_field(df, path)
    kind = dict(df.dtypes).get(path)
    if kind in ("timestamp", "timestamp_ntz"):
        # compared as it is stored, so that the filter reaches the scan
        return df.where(time > F.lit(cutoff.isoformat(sep=" ")).cast(kind))
    return df.where(F.try_to_timestamp(time) > F.lit(cutoff.isoformat(sep=" ")).cast("timestamp"))


def filter_events(df: DataFrame, event_types: list[str], path: str = "event_type") -> DataFrame:
    return df.where(event_field(df, path).isin(event_types))


def filter_courses(df: DataFrame, courses: list[str], path: str = "context:course_id") -> DataFrame:
    """Events of the listed courses; events without a course go."""
    return df.where(event_field(df, path).isin(courses))


def filter_fields(df: DataFrame, spec: dict[str, list[str | int | float | bool | None]]) -> DataFrame:
    """Every path must hold one of its listed values; None in a list stands for a missing value.

    Text matches text, a number the same number however it is written, and true or false only itself.
    """
    return df.where(reduce(and_, [_one_of(df, path, values) for path, values in spec.items()], F.lit(True)))


def _one_of(df: DataFrame, path: str, values: list[str | int | float | bool | None]) -> Column:
    kinds = {
        "string": [v for v in values if isinstance(v, str)],
        "boolean": [v for v in values if isinstance(v, bool)],
        "double": [float(v) for v in values if isinstance(v, int | float) and not isinstance(v, bool)],
    }
    text = event_field(df, path)
    some = F.lit(False)
    if path in df.columns:
        of = dict(df.dtypes)[path]
        own = of if of in ("string", "boolean") else "double"
        if kinds[own]:
            some = text.isin(kinds[own])
    else:
        value = event_field(df, path, "variant")
        kind = F.schema_of_variant(value)
        if kinds["string"]:
            some = some | (text.isin(kinds["string"]) & (kind == "STRING"))
        if kinds["boolean"]:
            some = some | (F.try_variant_get(value, "$", "boolean").isin(kinds["boolean"]) & (kind == "BOOLEAN"))
        if kinds["double"]:
            numeric = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
            some = some | (F.try_variant_get(value, "$", "double").isin(kinds["double"]) & numeric)
    some = F.coalesce(some, F.lit(False))
    return some | text.isNull() if None in values else some


def exclude_list(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows whose name is not listed; rows without a name stay."""
    return df.where(~F.coalesce(F.col(column).isin(names), F.lit(False)))


def low_income_codes(df: DataFrame, bound: int = 3000) -> DataFrame:
    """Two-letter codes, without the leading dot, of countries below a per-capita product."""
    code = F.col("Internet_country_code")
    return df.where((F.col("GDP_per_capita_PPP") < bound) & (F.length(code) > 0)).select(
        F.substring(code, 2, 2).alias("code")
    )
