"""Hashes, shard names and user tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Token alphabet, token width and the stand-in for a missing user.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOKEN_WIDTH = 3
TOKEN_CAPACITY = len(LETTERS) ** TOKEN_WIDTH
NO_USER = "___NONE___"


def short_hash(text: Column, length: int = 3) -> Column:
    """First hex digits of the md5: good for sharding, not for identity."""
    return F.substring(F.md5(text), 1, length)


def all_short_hashes(spark: SparkSession, length: int = 3) -> DataFrame:
    """Every shard name of that length, in order."""
    return spark.range(16**length).select(F.lower(F.lpad(F.hex("id"), length, "0")).alias("shard"))


def token_capacity(width: int = TOKEN_WIDTH, capacity: int | None = None) -> int:
    """How many users get a token of that width; a wish for more than there are is an error."""
    most = len(LETTERS) ** width
    if capacity is not None and capacity > most:
        raise ValueError(f"there are {most} tokens of {width} letters, fewer than {capacity}")
    return most if capacity is None else capacity


def token(number: Column, width: int = TOKEN_WIDTH) -> Column:
    """Letters for a running number from 0, most significant letter first."""
    base = len(LETTERS)
    digits = [F.floor(number / F.lit(base**power)) % base for power in reversed(range(width))]
    return F.concat(*[F.substr(F.lit(LETTERS), (digit + 1).cast("int"), F.lit(1)) for digit in digits])
