"""Cleaning of event records: payload decoding, redundant context, long strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.functions.json_text import as_object, hide_escapes, is_text, record_text, show_escapes, strict_value
from eventmill.functions.once import computed, let

# Each JSON-encoded string wraps quotes that the next encoding must escape, so the text at least doubles per level;
# a cell holds less than 2**31 bytes, hence no value is encoded more often than this.
MOST_ENCODINGS = 32


def replace_value(rec: Column, key: str, change: Callable[[Column], Column]) -> Column:
    """Record with the value under one key changed."""
    return F.transform_values(rec, lambda k, v: F.when(k == key, change(v)).otherwise(v))


def decode_event_payload(df: DataFrame) -> DataFrame:
    """Decode `event` while it is a JSON string; text that is no JSON becomes `Truncated`."""

    def state(value: Column, still_text: Column) -> Column:
        return F.struct(value.alias("value"), still_text.alias("still_text"))

    def step(now: Column, _: Column) -> Column:
        decoded = let(
            strict_value(F.try_variant_get(now["value"], "$", "string")),
            lambda v: state(F.coalesce(v, F.parse_json(F.lit('"Truncated"'))), F.coalesce(is_text(v), F.lit(False))),
        )
        return F.when(now["still_text"], decoded).otherwise(now)

    def change(value: Column) -> Column:
        # twice as long at least per encoding: the binary digits of the length bound how often there is something to decode
        digits = F.length(F.bin(F.length(F.try_variant_get(value, "$", "string"))))
        rounds = F.sequence(F.lit(1), F.least(digits + 1, F.lit(MOST_ENCODINGS)))
        decoded = F.aggregate(rounds, state(value, F.lit(True)), step, lambda last: last["value"])
        return F.when(is_text(value), decoded).otherwise(value)

    return computed(df, "rec", replace_value(F.col("rec"), "event", change))


def remove_redundant_context(df: DataFrame) -> DataFrame:
    """Drop context entries that repeat a top-level field, the course user tags, and a context left empty."""
    rec = F.col("rec")

    def repeats(k: Column, v: Column) -> Column:
        return F.coalesce(F.map_contains_key(rec, k) & (record_text(v) == record_text(rec[k])), F.lit(False))

    def clean(entries: Column) -> Column:
        kept = F.map_filter(entries, lambda k, v: (k != "course_user_tags") & ~repeats(k, v))
        return let(kept, lambda left: F.when(F.size(left) > 0, F.to_variant_object(left)))

    def change(context: Column) -> Column:
        return let(as_object(context), lambda entries: F.when(entries.isNull(), context).otherwise(clean(entries)))

    # what is left empty is SQL NULL here, unlike a null in the JSON
    return computed(
        df, "rec", F.map_filter(replace_value(rec, "context", change), lambda k, v: (k != "context") | v.isNotNull())
    )


def _shortened(json: Column, most: int) -> Column:
    """JSON text in which every string value longer than `most` is null; keys stay."""
    pieces = F.regexp_extract_all(hide_escapes(json), F.lit('"[^"]*+":?|[^"]++'), F.lit(0))

    def shorten(piece: Column) -> Column:
        characters = F.length(F.regexp_replace(piece, r"\\(?:u[0-9a-fA-F]{4}|.)", "_")) - 2
        long = (F.length(piece) - 2 > most) & piece.startswith('"') & piece.endswith('"') & (characters > most)
        return F.when(long, "null").otherwise(piece)

    return show_escapes(F.array_join(F.transform(pieces, shorten), ""))


def truncate_strings(df: DataFrame, most: int) -> DataFrame:
    """Strings longer than `most` become null, at any depth. Works on `rec` or, without one, on all typed columns."""
    if "rec" not in df.columns:
        return df.select(*[_short_typed(F.col(f"`{f.name}`"), f.dataType, most).alias(f.name) for f in df.schema])
    null = F.parse_json(F.lit("null"))

    def shorten(value: Column) -> Column:
        # objects and lists are taken apart only when they have room for a long string
        nested = let(
            record_text(value),
            lambda json: F.when(F.length(json) > most + 2, F.parse_json(_shortened(json, most))).otherwise(value),
        )
        changed = let(
            F.schema_of_variant(value),
            lambda kind: F.when(kind == "STRING", null).when(kind.rlike("^(OBJECT|ARRAY)"), nested).otherwise(value),
        )
        # a value whose whole text is no longer holds no long string: most values need no second look
        return F.when(F.length(F.try_variant_get(value, "$", "string")) > most, changed).otherwise(value)

    return computed(df, "rec", F.transform_values("rec", lambda key, value: shorten(value)))


def _short_typed(column: Column, data_type: T.DataType, most: int) -> Column:
    if isinstance(data_type, T.StringType):
        return F.when(F.length(column) <= most, column)
    if isinstance(data_type, T.ArrayType) and _holds_text(data_type):
        return F.transform(column, lambda x: _short_typed(x, data_type.elementType, most))
    if isinstance(data_type, T.MapType) and _holds_text(data_type.valueType):
        return F.transform_values(column, lambda k, v: _short_typed(v, data_type.valueType, most))
    if isinstance(data_type, T.StructType) and _holds_text(data_type):
        inner = [_short_typed(column[f.name], f.dataType, most).alias(f.name) for f in data_type]
        return F.when(column.isNotNull(), F.struct(*inner))
    return column


def _holds_text(data_type: T.DataType) -> bool:
    return "string" in data_type.simpleString()
