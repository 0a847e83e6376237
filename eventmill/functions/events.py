"""What one event says about its origin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(text: Column, index: int) -> Column:
    return F.get(F.split(text, "/"), F.lit(index))


def source_institution(source: Column, kind: Column, page: Column, problem_id: Column) -> Column:
    """Institution an event belongs to, from its source, type, page and problem id."""
    server = (
        F.when(kind.contains("/courses/"), _part(kind, 2))
        .when(kind.contains("/"), F.lit("Global"))
        .otherwise(F.coalesce(_part(problem_id, 2), F.lit("Unhandled")))
    )
    browser = F.when(page.contains("courses"), _part(page, 4)).when(page.isNotNull(), F.lit("BGE"))
    return F.when(source == "server", server).when(source == "browser", browser)


def event_date(time: Column) -> Column:
    """Date part of an ISO time, `XX` when there is none."""
    return F.coalesce(F.split_part(time, F.lit("T"), F.lit(1)), F.lit("XX"))
