"""Fields of an event, addressed as `a:b:c`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Paths that caches store as plain columns next to the record, so that later scans prune columns and push filters down.
HOT_PATHS = {
    "username": "username",
    "event_type": "event_type",
    "event_source": "event_source",
    "time": "time",
    "course_id": "context:course_id",
}


def json_path(keys: list[str]) -> str:
    return "$" + "".join(f'["{key}"]' for key in keys)


def field(path: str, as_type: str = "string", rec: str = "rec") -> Column:
    """Value at `path` of the record column, NULL where any step is missing."""
    head, *rest = path.split(":")
    return F.try_variant_get(F.col(rec)[head], json_path(rest), as_type)


def event_field(df: DataFrame, path: str, as_type: str = "string", rec: str = "rec") -> Column:
    """Plain column when the frame has one of that name (scans can then prune and push down), else the record.

    A nested path of a cache is found under the name of its hot column.
    """
    if path in df.columns:
        return F.col(f"`{path}`")
    hot = next((name for name, of in HOT_PATHS.items() if of == path), None)
    if hot in df.columns and rec in df.columns and set(HOT_PATHS) <= set(df.columns):
        return F.col(f"`{hot}`")
    return field(path, as_type, rec)
