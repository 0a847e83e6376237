"""Flattening of nested records, level by level inside the row: no explode, no regrouping, one pass."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.functions.json_text import as_object, record_text
from eventmill.functions.once import computed, let
from eventmill.operators.clean import decode_event_payload
from eventmill.session import ensure_checkpoints

# Paths left out of a schema profile, since they hold answers rather than structure.
UNPROFILED = ["correct_map.", "submission", "answers", "POST"]


_ENTRIES = "array<struct<path:string,value:variant>>"
_STATE = f"struct<found:{_ENTRIES},open:{_ENTRIES}>"


#: Steps of the walk that are written out; what is open after them is counted and walked in a loop.
_PLAIN_STEPS = 2


def _step(state: Column, separator: str) -> Column:
    """One level further down: what is open and no object is found, the entries of objects are open next."""

    def split(inner: Column) -> Column:
        def entries(entry: Column, i: Column) -> Column:
            return F.transform(
                F.map_entries(F.get(inner, i)),
                lambda x: F.struct(F.concat(entry["path"], F.lit(separator), x["key"]).alias("path"), x["value"].alias("value")),
            )

        closed = F.filter(state["open"], lambda entry, i: F.get(inner, i).isNull())
        below = F.filter(F.transform(state["open"], entries), lambda found: found.isNotNull())
        return F.struct(F.concat(state["found"], closed).alias("found"), F.flatten(below).alias("open"))

    inner = F.transform(state["open"], lambda entry: as_object(entry["value"]))
    return F.when(F.size(state["open"]) == 0, state).otherwise(let(inner, split).cast(_STATE))


def leaves(df: DataFrame, separator: str = ".", levels: int | None = None) -> DataFrame:
    """Add `leaves`, the array of `(path, value)` below the record; lists and nulls are leaves, `{}` vanishes.

    The walk goes on inside the row, level by level until nothing is open: for two levels as it is, then in a loop, for at
    most as many levels as what is left has opening braces. Nothing has to be known beforehand and records are parsed once.
    With `levels` a deeper record is an error.
    """
    entries = F.transform(F.map_entries("rec"), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value")))
    start = F.struct(F.array().cast(_ENTRIES).alias("found"), entries.alias("open")).cast(_STATE)
    plain = min(levels, _PLAIN_STEPS) if levels else _PLAIN_STEPS

    def end(state: Column) -> Column:
        # fails on the first entry that is still open, and only there
        too_deep = F.transform(
            state["open"],
            lambda e: F.struct(
                F.raise_error(F.concat(F.lit(f"record nested deeper than {levels} levels at "), e["path"])).cast("string").alias("path"),
                e["value"].alias("value"),
            ),
        )
        return F.concat(state["found"], too_deep).cast(_ENTRIES) if levels else state["found"]

    def loop(state: Column) -> Column:
        if levels:
            rounds = F.lit(levels - plain)
        else:
            text = record_text(F.transform(state["open"], lambda e: e["value"]))
            rounds = let(text, lambda t: F.length(t) - F.length(F.replace(t, F.lit("{"), F.lit("")))) + 1
        return F.aggregate(F.sequence(F.lit(1), rounds), state, lambda now, _: _step(now, separator), end)

    def walk(state: Column, steps: int) -> Column:
        if steps:
            return let(_step(state, separator), lambda now: walk(now, steps - 1))
        return F.when(F.size(state["open"]) == 0, state["found"]).otherwise(end(state) if levels == plain else loop(state))

    walked = let(start, lambda state: walk(state, plain))
    return df.withColumn("leaves", F.when(F.col("rec").isNotNull(), walked))


def field_names(df: DataFrame, separator: str = ".", levels: int | None = None) -> DataFrame:
    """Distinct leaf paths of all records."""
    paths = F.transform("leaves", lambda leaf: leaf["path"])
    # exploding an expression, unlike a column, adds no filter that would compute the leaves a second time
    return leaves(df, separator, levels).select(F.explode(paths).alias("path")).distinct()


def flatten(df: DataFrame, separator: str = ".", levels: int | None = None) -> DataFrame:
    """Replace `rec` by a map of one level whose keys are the leaf paths."""
    # computed once: a later explode of the record filters on it, which would walk every record again
    return computed(leaves(df, separator, levels), "rec", F.map_from_entries("leaves")).drop("leaves")


def _kind(schema: Column) -> Column:
    plain = F.when(schema == "VOID", "null").when(schema.isin("STRING", "BOOLEAN"), F.lower(schema))
    return plain.when(schema.startswith("ARRAY"), "array").otherwise("number")


def schema_profile(df: DataFrame, ordinal: str, levels: int | None = None) -> DataFrame:
    """Every path of the decoded records with its count, its last example and its types, in path order.

    `types` names the kinds of values that occur (array, boolean, null, number, string), `schema` the narrowest type that
    holds them all.

    Two passes: the first counts paths and narrow types in numbers only, so a task holds one small row per path and type
    instead of sorting the leaves for their text; the second parses and walks again just the records that come last. Rows
    must have the same ordinal both times.
    """
    def profiled(leaf):
        return ~reduce(or_, [leaf["path"].contains(part) for part in UNPROFILED])

    def walked(records: DataFrame) -> DataFrame:
        return leaves(decode_event_payload(records), ".", levels).select(
            F.col(ordinal).alias("ordinal"), F.explode(F.filter("leaves", profiled)).alias("leaf")
        ).select("ordinal", "leaf.path", "leaf.value")

    ensure_checkpoints(df.sparkSession)
    counted = (
        walked(df).groupBy("path", F.schema_of_variant("value").alias("kind"))
        .agg(F.count(F.lit(1)).alias("records"), F.max("ordinal").alias("last")).checkpoint()
    )
    last = counted.select("last").distinct()
    chosen = df.join(F.broadcast(last), F.col(ordinal).eqNullSafe(F.col("last")), "left_semi")
    examples = (
        walked(chosen).withColumns({"text": record_text(F.col("value")), "kind": _kind(F.schema_of_variant("value"))})
        .groupBy("path")
        .agg(
            F.max_by("text", "ordinal").alias("example"),
            F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("types"),
            F.schema_of_variant_agg("value").alias("schema"),
        )
    )
    records = counted.groupBy("path").agg(F.sum("records").alias("records"))
    return records.join(examples, "path").orderBy("path")
