"""Text cells to typed values, and names safe for SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column, sql_type: str, lenient: bool) -> Column:
    text = F.nullif(text, F.lit(""))
    return text.try_cast(sql_type) if lenient else text.cast(sql_type)


def parse_int(text: Column, lenient: bool = False) -> Column:
    """Whole number; empty is NULL; other text fails unless lenient."""
    return _number(text, "bigint", lenient)


def parse_float(text: Column, lenient: bool = False) -> Column:
    """Floating number; empty is NULL; other text fails unless lenient."""
    return _number(text, "double", lenient)


def parse_dollars(text: Column, lenient: bool = False) -> Column:
    """Dollar amount such as `$ 1200` as a whole number."""
    return _number(F.trim(F.translate(text, "$ ", "")), "bigint", lenient)


def clean_name(text: Column) -> Column:
    """Every run of characters that are not ASCII letters or digits becomes one `_`; none at the ends."""
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_"))


def clean_header(name: str) -> str:
    """The same rule for one column name."""
    return re.sub("[^A-Za-z0-9]+", "_", name).strip("_")
