"""Joins with small tables: named users, lookups, user reports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.functions.grams import filter_words, name_numbers, possible_names
from eventmill.functions.paths import event_field
from eventmill.session import scratch_path

# A few names are looked for one by one in generated code. Larger lists are joined by numbers of the names.
FEW_NAMES = 16


def filter_lines_by_users(
    df: DataFrame, users: DataFrame, column: str = "value", user: str = "username", few: int = FEW_NAMES, automaton: bool = False
) -> DataFrame:
    """Lines in which any of the user names occurs anywhere. Names are trimmed; blank ones are ignored.

    Up to `few` names become tests in the filter, more are joined. With `automaton`, every task gets all names as one
    automaton instead: for lists that fit a Python worker, and for streams. All ways give the same rows.
    """
    names = users.select(F.btrim(user).alias("name")).where(F.length("name") > 0).distinct()
    if automaton:
        return df.where(_mentions_any(df, [row["name"] for row in names.collect()])(F.col(column)))
    first = [row["name"] for row in names.limit(few + 1).collect()]
    if len(first) <= few:
        return df.where(reduce(or_, [F.col(column).contains(name) for name in first], F.lit(False)))
    return _join_names(df, names, column)


def _mentions_any(df: DataFrame, names: list[str]):
    shared = df.sparkSession.sparkContext.broadcast(names)

    # everything the function needs travels with it, so workers do not need this package
    @F.pandas_udf("boolean")
    def mentions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from ahocorasick import Automaton

        automaton = Automaton()
        for name in shared.value:
            automaton.add_word(name, True)
        automaton.make_automaton()
        for lines in batches:
            yield lines.map(lambda line: bool(shared.value) and line is not None and next(automaton.iter(line), None) is not None)

    return mentions


def _join_names(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Substring search as an equality join on numbers of names, for lists of any size; what meets is verified.

    Each line looks for stretches whose numbers may be those of names, by filters of bounded size: no row is made of the
    others, and lines without any go at once. A line is joined with the first of them; only one whose first is no name
    becomes a row for each of the rest. Lines are read one time.
    """
    numbers = name_numbers("name")
    known = _saved(names.select("name", F.octet_length("name").alias("size"), numbers["head"].alias("head"), numbers["whole"].alias("whole")))
    sizes = {row["size"]: row["n"] for row in known.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return df.limit(0)
    filters = filter_words(known, ["head", "whole"], sum(sizes.values()))
    text = F.col(f"`{column}`")
    lines = df.select("*", F.monotonically_increasing_id().alias("_line"), possible_names(df.sparkSession, text, *filters, sorted(sizes)).alias("_all"))

    def named(number: str, name: str) -> DataFrame:
        return known.select(F.col("whole").alias(number), F.col("name").alias(name))

    first = lines.where(F.size("_all") > 0).withColumn("_first", F.get("_all", F.lit(0))).join(named("_first", "_name"), "_first", "left")
    first = first.withColumn("_found", F.coalesce(text.contains(F.col("_name")), F.lit(False)))
    others = F.when(F.col("_found"), F.array(F.lit(None).cast("bigint"))).otherwise(F.slice("_all", F.lit(2), F.size("_all")))
    more = first.withColumn("_other", F.explode(others)).join(named("_other", "_next"), "_other", "left")
    held = more.where(F.col("_found") | text.contains(F.col("_next")))
    return held.dropDuplicates(["_line"]).select(*[F.col(f"`{c}`") for c in df.columns])


def _saved(names: DataFrame) -> DataFrame:
    """The names with their numbers, made once for the filters and the joins."""
    path = scratch_path(names.sparkSession, "names")
    names.write.parquet(path)
    return names.sparkSession.read.schema(names.schema).parquet(path)


def filter_events_by_users(df: DataFrame, users: DataFrame, path: str = "username", user: str = "username") -> DataFrame:
    """Events whose user is listed: an equality join on the parsed field."""
    names = users.select(F.btrim(user).alias("_name")).distinct()
    return df.withColumn("_name", event_field(df, path)).join(names, "_name", "left_semi").drop("_name")


def lookup_join(df: DataFrame, table: DataFrame, on: str, value: str, strict: bool = True) -> DataFrame:
    """Add one value per name; a name that is not in the table fails, or gives NULL when not strict.

    A name that the table lists more than once fails when it is looked up; one that is listed with NULL gives NULL.
    """
    listed = table.groupBy(on).agg(F.max(value).alias("_value"), F.count(F.lit(1)).alias("_times"))
    found = df.join(listed, on, "left")
    kind = table.schema[value].dataType
    name = F.coalesce(F.col(on).cast("string"), F.lit("NULL"))
    repeated = F.raise_error(F.concat(F.lit(f"more than one {value} for "), name)).cast(kind)
    missing = F.raise_error(F.concat(F.lit(f"no {value} for "), name)).cast(kind) if strict else F.lit(None).cast(kind)
    chosen = F.when(F.col("_times") == 1, F.col("_value")).when(F.col("_times") > 1, repeated).otherwise(missing)
    return found.withColumn(value, chosen).drop("_value", "_times")
