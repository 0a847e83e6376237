"""Jobs over activity logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.functions.identity import TOKEN_WIDTH
from eventmill.functions.json_text import record_text
from eventmill.functions.paths import field
from eventmill.operators.clean import decode_event_payload, remove_redundant_context, truncate_strings
from eventmill.operators.filters import date_gt
from eventmill.operators.joins import filter_lines_by_users
from eventmill.operators.ordering import big_sort
from eventmill.operators.parse import parse_events
from eventmill.operators.privacy import desensitize, record_user_tokens
from eventmill.sources.cached import cache_events
from eventmill.sources.lines import read_lines, save_events
from eventmill.sources.shards import write_shards

# What desensitizing removes at the top and in the context, and in the event.
SENSITIVE_FIELDS = ["agent", "ip", "host", "user_id", "session"]
SENSITIVE_EVENT_FIELDS = ["csrfmiddlewaretoken", "session"]
LONGEST_SORTED_STRING = 500


def clean_and_desensitize(
    df: DataFrame, ordinal: str, mindate: str | None = None, tokens: DataFrame | None = None, width: int = TOKEN_WIDTH
) -> DataFrame:
    """Lines, or records of a cache, to masked records: cut by date, decode payloads, drop repetition and personal fields.

    Without a table of tokens, users are numbered by their first record.
    """
    records = date_gt(df if "rec" in df.columns else parse_events(df), mindate)
    cleaned = remove_redundant_context(decode_event_payload(records))
    # cleaning leaves the user alone, so the tokens need no cleaned records
    tokens = record_user_tokens(records, ordinal, width) if tokens is None else tokens
    return desensitize(cleaned, SENSITIVE_FIELDS, SENSITIVE_EVENT_FIELDS, ordinal, tokens, width)


def desensitize_to(df: DataFrame, ordinal: str, out: str, mindate: str | None = None, format: str = "json") -> None:
    """Write the masked records as gzip JSON lines or as a columnar cache."""
    masked = clean_and_desensitize(df, ordinal, mindate)
    if format == "json":
        save_events(masked.select("rec"), out)
    elif format == "parquet":
        cache_events(masked.select("rec"), out)
    else:
        raise ValueError(f"unknown format: {format}")


def sort_log(df: DataFrame) -> DataFrame:
    """Log lines sorted by user, then time: payloads decoded, long strings dropped."""
    records = truncate_strings(decode_event_payload(parse_events(df)), LONGEST_SORTED_STRING)
    key = F.concat(F.coalesce(field("username"), F.lit("")), F.lit(" "), F.coalesce(field("time"), F.lit("")))
    # the text is made before the sort: a map cannot be compared, and it is what ties are broken by
    lines = records.select(key.alias("key"), record_text(F.col("rec")).alias("value"))
    # A global sort reads its input twice, first for a sample. Decoding costs far more than a shuffle: rebalanced,
    # the second read finds the decoded lines.
    return big_sort(lines.hint("rebalance"), F.col("key")).select("value")


def filter_log_by_users(spark: SparkSession, source: str, users: DataFrame, out: str) -> None:
    """Copy the lines that name a listed user, as gzip text in one folder `file=<name>` per input file.

    The name is the path below the source, with `_1` for `/` and `_0` for `_`, so that no two files share a folder.
    """
    lines = filter_lines_by_users(read_lines(spark, source, ascii=False, file_column="file"), users)
    top = source.rstrip("/") + "/"
    below = F.substr("file", F.instr(F.col("file"), F.lit(top)) + len(top))
    name = F.replace(F.replace(below, F.lit("_"), F.lit("_0")), F.lit("/"), F.lit("_1"))
    write_shards(lines.select(name.alias("file"), "value"), out, column="file")
