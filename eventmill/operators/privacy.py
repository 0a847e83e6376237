"""Removal of personal fields and replacement of user names by tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.functions.identity import TOKEN_CAPACITY, TOKEN_WIDTH, token, token_capacity
from eventmill.functions.json_text import as_object, record_text
from eventmill.functions.once import computed
from eventmill.operators.clean import replace_value
from eventmill.operators.ordering import number_rows


def user_tokens(df: DataFrame, user: Column, ordinal: Column, capacity: int | None = None, width: int = TOKEN_WIDTH) -> DataFrame:
    """Table `(user, token)` in order of first appearance; more users than there are tokens is an error.

    Users are reduced to their first ordinal before the shuffle. Tokens of the usual width are so few that only the first
    of all users and one more are ranked, in one task of fixed size; for wider ones the users are numbered by ranges.
    """
    capacity = token_capacity(width, capacity)
    first = df.where(user.isNotNull()).groupBy(user.alias("user")).agg(F.min(ordinal).alias("first"))
    # two users with the same ordinal are told apart by name
    if capacity <= TOKEN_CAPACITY:
        ranked = first.orderBy("first", "user").limit(capacity + 1)
        ranked = ranked.withColumn("number", F.row_number().over(Window.orderBy("first", "user")) - 1)
    else:
        ranked = number_rows(first, "first", "user", name="number")
    full = F.raise_error(F.lit(f"more than {capacity} users, and no token left")).cast("string")
    return ranked.select("user", F.when(F.col("number") < capacity, token(F.col("number"), width)).otherwise(full).alias("token"))


def tokenize_users(df: DataFrame, column: str, ordinal: str, capacity: int | None = None, width: int = TOKEN_WIDTH) -> DataFrame:
    """Replace the user column by its token; rows without a user stay without."""
    tokens = user_tokens(df, F.col(column), F.col(ordinal), capacity, width)
    small = token_capacity(width, capacity) <= TOKEN_CAPACITY
    return _with_token(df, F.col(column), tokens, small).withColumn(column, F.col("_token")).drop("_token")


def _with_token(df: DataFrame, user: Column, tokens: DataFrame, small: bool = True) -> DataFrame:
    # Keyed by digest a small table has at most TOKEN_CAPACITY rows of a few dozen bytes, whatever the names are like:
    # it is safe to broadcast, and the events themselves are not shuffled, however many belong to one user.
    digests = tokens.select(F.unhex(F.sha2("user", 256)).alias("_digest"), F.col("token").alias("_token"))
    return (
        df.withColumn("_digest", F.unhex(F.sha2(user, 256)))
        .join(F.broadcast(digests) if small else digests, "_digest", "left")
        .drop("_digest")
    )


def _without(entries: Column, names: list[str]) -> Column:
    return F.map_filter(entries, lambda k, v: ~k.isin(names)) if names else entries


def drop_fields(df: DataFrame, fields: list[str], event_fields: list[str]) -> DataFrame:
    """Remove `fields` at the top and in `context`, and `event_fields` in `event`; plain columns of the names in `fields` go."""

    def cleaned(names: list[str]):
        return lambda v: F.coalesce(F.to_variant_object(_without(as_object(v), names)), v)

    rec = _without(F.col("rec"), fields)
    rec = F.transform_values(
        rec,
        lambda k, v: F.when(k == "context", cleaned(fields)(v)).when(k == "event", cleaned(event_fields)(v)).otherwise(v),
    )
    plain = [name for name in df.columns if name in fields and name != "rec"]
    return computed(df.drop(*plain), "rec", rec)


def record_user_tokens(df: DataFrame, ordinal: str, width: int = TOKEN_WIDTH) -> DataFrame:
    """Tokens of the `username` of records, as `desensitize` wants them."""
    return user_tokens(df, record_text(F.col("rec")["username"]), F.col(ordinal), width=width)


def desensitize(
    df: DataFrame, fields: list[str], event_fields: list[str], ordinal: str, tokens: DataFrame | None = None, width: int = TOKEN_WIDTH
) -> DataFrame:
    """Remove the listed fields, then replace the user names that are left by tokens.

    Plain columns are masked with the record: those of listed fields go, and a column `username` holds the token. The
    tokens take a pass of their own over the records; made from records as they were before costly steps and given
    here, that pass is cheaper.
    """
    if ordinal in fields:
        raise ValueError(f"{ordinal} orders the users and cannot be removed with them")
    dropped = drop_fields(df, fields, event_fields)
    if "username" in fields:
        return dropped
    tokens = record_user_tokens(df, ordinal, width) if tokens is None else tokens
    named = _with_token(dropped, record_text(F.col("rec")["username"]), tokens, token_capacity(width) <= TOKEN_CAPACITY)
    known = replace_value(F.col("rec"), "username", lambda v: F.col("_token").try_cast("variant"))
    masked = computed(named, "rec", F.when(F.col("_token").isNotNull(), known).otherwise(F.col("rec")))
    if "username" in df.columns:
        masked = masked.withColumn("username", F.col("_token"))
    return masked.drop("_token")
