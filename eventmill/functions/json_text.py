"""JSON text to records and back, with the strictness of a standard JSON decoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventmill.functions.once import let

RECORD = "map<string,variant>"
_STRICT = {"allowSingleQuotes": "false"}
# A closing and an opening bracket side by side: the one shape an array wrapper cannot tell from two values.
_SPLIT_ARRAYS = r"\]\s*\["


def strip_space(text: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def ascii_only(text: Column) -> Column:
    """Drop every character outside ASCII; as many bytes as characters means there is none."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


def _whole(text: Column) -> Column:
    """Whether text that parses inside `[...]` is one value: only `a][b` is not, and that fails inside `{...}`."""
    nested = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "struct<v variant>", _STRICT)
    return ~text.rlike(_SPLIT_ARRAYS) | nested["v"].isNotNull()


def strict_record(text: Column) -> Column:
    """`map<string,variant>` of a JSON object; NULL for any other text, trailing text included."""

    def parse(line: Column) -> Column:
        wrapped = F.from_json(F.concat(F.lit("["), line, F.lit("]")), f"array<{RECORD}>", _STRICT)
        # map_entries + map_from_entries makes the last of several equal keys win
        record = let(wrapped, lambda a: F.when(F.size(a) == 1, F.map_from_entries(F.map_entries(F.get(a, F.lit(0))))))
        return F.when(line.startswith("{") & line.endswith("}") & _whole(line), record)

    return let(text, parse)


def strict_value(text: Column) -> Column:
    """Variant of any JSON text; NULL when it is not one complete JSON value."""

    def parse(value: Column) -> Column:
        wrapped = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<variant>", _STRICT)
        return F.when(_whole(value), let(wrapped, lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))))

    return let(text, parse)


def record_text(record: Column) -> Column:
    """Record (or any variant) as JSON text."""
    return F.to_json(record)


def sorted_record_text(record: Column) -> Column:
    """Record as JSON text with its keys in order; nested objects are printed in key order anyway."""
    return let(
        F.sort_array(F.map_keys(record)),
        lambda keys: F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda key: record[key]))),
    )


def as_object(value: Column) -> Column:
    """Entries of a variant object, NULL for every other kind of value."""
    return F.try_variant_get(value, "$", RECORD)


def is_text(value: Column) -> Column:
    """Whether a variant holds a string."""
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def as_text(value: Column) -> Column:
    """The string held by a variant string, NULL for every other kind of value."""
    return F.when(is_text(value), F.try_variant_get(value, "$", "string"))


# Control characters never stand raw in JSON text: they can hold the place of an escaped backslash or quote.
_BACKSLASH, _QUOTE = "\x02", "\x01"


def hide_escapes(json: Column) -> Column:
    """JSON text in which every `"` begins or ends a string."""
    return F.replace(F.replace(json, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


def show_escapes(json: Column) -> Column:
    return F.replace(F.replace(json, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
