"""Ways to have an expensive expression evaluated one time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` speaks of it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add or replace a column that later filters are not pushed into.

    A filter on a projected column is evaluated below the projection, and so computes the column a second time. It is
    not moved below a generator.
    """
    return kept(df, name, F.array(value))


def kept(df: DataFrame, name: str, values: Column) -> DataFrame:
    """The same for an array: one row per element, and none where it is empty or NULL."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode(values).alias(name))
