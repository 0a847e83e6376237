"""Sorting, merging and numbering of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.functions.paths import event_field
from eventmill.session import ensure_checkpoints


def sort_events(df: DataFrame, fields: list[str]) -> DataFrame:
    """Ascending by several paths, missing values first."""
    return df.orderBy(*[event_field(df, path).asc_nulls_first() for path in fields])


def big_sort(df: DataFrame, key: Column, line: str = "value") -> DataFrame:
    """Total order by a computed key, equal keys by line: ranges of the pair are shuffled, then sorted with spill."""
    return df.orderBy(key, F.col(line))


def learner_traces(df: DataFrame, user: str = "username", time: str = "time", ordinal: str | None = None) -> DataFrame:
    """Every user's events next to each other and in time order.

    Rows are cut into ranges of (user, time), not hashed by user, so a user with a large part of all events is spread
    over several tasks and files that follow each other.
    """
    keys = [event_field(df, user), event_field(df, time)]
    return df.orderBy(*keys, *([F.col(ordinal)] if ordinal else []))


def peek(df: DataFrame, n: int = 10, *order: str) -> DataFrame:
    """The first rows, in a given order if there is one."""
    return (df.orderBy(*order) if order else df).limit(n)


def merge_sorted(frames: list[DataFrame], key: str, ordinal: str | None = None) -> DataFrame:
    """All rows of all frames, greatest key first; equal keys in the order of the frames, in a frame as it has them.

    Frames that are sorted already are merged by one exchange into ranges. The place of a row in its frame goes with it:
    the column `ordinal` where rows have one, else their order as they are read. So rows with equal keys of one frame keep
    their order; with an ordinal the result is the same in however many partitions, and in whatever order, files are read.
    """
    place = F.col(f"`{ordinal}`") if ordinal else F.monotonically_increasing_id()
    numbered = [frame.withColumn("_place", place).withColumn("_source", F.lit(i)) for i, frame in enumerate(frames)]
    merged = reduce(DataFrame.unionByName, numbered)
    return merged.orderBy(F.col(key).desc(), "_source", "_place").drop("_source", "_place")


def number_rows(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Position of every row in a total order, from 0, without gathering the rows in one task.

    Without `order`, rows are numbered as a sort before this has left them. The sorted rows are checkpointed, so that ranges, counts and positions all speak of the same split even if an
    executor is lost.
    """
    ensure_checkpoints(df.sparkSession)
    ordered = (df.orderBy(*order) if order else df).withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    part, within = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    # one row per partition of the sort
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + within)
        .drop("_row", "_part", "_offset")
    )
