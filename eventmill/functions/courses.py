"""Course ids in one canonical spelling: organisation/course/run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _without_scheme(course: Column) -> Column:
    plus = F.when(course.startswith("course-v1:"), F.replace(F.substring(course, 11, 1 << 30), F.lit("+"), F.lit("/")))
    course = F.coalesce(plus, course)
    personal = F.split_part(F.replace(F.substring(course, 8, 1 << 30), F.lit("+"), F.lit("/")), F.lit("@"), F.lit(1))
    course = F.when(course.startswith("ccx-v1:"), personal).otherwise(course)
    return F.when(course.startswith("i4x://"), F.substring(course, 7, 1 << 30)).otherwise(course)


def _canonical_run(run: Column) -> Column:
    run = F.translate(run, "Q_-B", "T")
    run = F.when(run == "X", F.lit("2016")).otherwise(run)
    # term before year: 1T2016 -> 2016T1, then T12016 -> 2016T1
    run = F.when(F.substring(run, 2, 1) == "T", F.array_join(F.reverse(F.split(run, "T")), "T")).otherwise(run)
    return F.when(
        F.substring(run, 1, 1) == "T", F.concat(F.substring(run, 3, 1 << 30), F.substring(run, 1, 2))
    ).otherwise(run)


def canonical_course_parts(course: Column, strict: bool = False) -> Column:
    """Array of the parts with a canonical run; ids without a run stay as they are (or fail when strict)."""
    parts = F.split(_without_scheme(course), "/")
    run = _canonical_run(F.get(parts, F.lit(2)))
    canonical = F.transform(parts, lambda part, i: F.when(i == 2, run).otherwise(part))
    if strict:
        other = F.raise_error(F.concat(F.lit("course id without a run: "), course)).cast("array<string>")
    else:
        other = F.split(course, "/")
    return F.when(course.isNull(), F.lit(None)).when(F.length(run) > 0, canonical).otherwise(other)


def canonical_course(course: Column, strict: bool = False) -> Column:
    """Canonical id as `org/course/run`."""
    return F.array_join(canonical_course_parts(course, strict), "/")
