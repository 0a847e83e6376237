"""Lines spread over folders by a hash of the user, and rows over folders by id range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.functions.identity import NO_USER, short_hash
from eventmill.functions.json_text import sorted_record_text
from eventmill.functions.paths import field
from eventmill.operators.clean import remove_redundant_context, truncate_strings


def with_shard(df: DataFrame, user: Column, length: int = 3) -> DataFrame:
    """Add `shard`, the short hash of the user; all rows without a user share one shard."""
    return df.withColumn("shard", short_hash(F.coalesce(user, F.lit(NO_USER)), length))


def user_shards(df: DataFrame, most: int = 200) -> DataFrame:
    """`(shard, value)`: cleaned records as JSON text with sorted keys, long strings dropped."""
    cleaned = truncate_strings(remove_redundant_context(df), most)
    return with_shard(cleaned, field("username")).select("shard", sorted_record_text(F.col("rec")).alias("value"))


def write_shards(shards: DataFrame, path: str, mode: str = "errorifexists", column: str = "shard") -> None:
    """One folder of gzip text per shard.

    Rebalancing gathers a shard in few files and still splits one that is too large for a task, such as that of a
    very busy user.
    """
    writer = shards.hint("rebalance", column).write.mode(mode)
    writer.partitionBy(column).option("compression", "gzip").text(path)


def shard_by_user(df: DataFrame, path: str, most: int = 200, mode: str = "errorifexists") -> None:
    write_shards(user_shards(df, most), path, mode)


def read_shards(spark: SparkSession, runs: list[str], column: str = "shard") -> DataFrame:
    """All lines of several runs with their shard. The schema is given, as names like `001` would be read as numbers."""
    frames = [spark.read.schema(f"value string, {column} string").text(run) for run in runs]
    return reduce(DataFrame.unionByName, frames)


def read_shard(spark: SparkSession, name: str, runs: list[str]) -> DataFrame:
    """Lines of one shard in all runs; only that shard's folders are listed and read, runs without it add nothing."""
    if not name.isalnum():
        # the name of its folder is written in another way
        return read_shards(spark, runs).where(F.col("shard") == name).select("value")
    reader = spark.read.schema("value string, shard string")
    found = [folder for run in runs for folder in _folders(spark, f"{run}/shard={name}")]
    frames = [reader.option("basePath", folder.rsplit("/", 1)[0]).text(folder) for folder in found]
    if not frames:
        frames = [spark.createDataFrame([], "value string, shard string")]
    return reduce(DataFrame.unionByName, frames).where(F.col("shard") == name).select("value")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The folders of that name, which may be a pattern; none if there is no such folder."""
    sought = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = sought.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(sought)
    return [status.getPath().toString() for status in found or []]


def id_chunks(df: DataFrame, id_column: str, condition: Column, columns: list[str], size: int = 100_000) -> DataFrame:
    """Rows that meet the condition with their `chunk`: chunk c holds the ids in (c * size, (c + 1) * size]."""
    in_range = F.col(id_column) > 0
    return df.where(in_range & condition).select(F.expr(f"(`{id_column}` - 1) div {size}").alias("chunk"), *columns)


def snapshot_by_id_range(
    df: DataFrame, path: str, id_column: str, condition: Column, columns: list[str], size: int = 100_000,
    mode: str = "errorifexists",
) -> None:
    """Tab-separated gzip text per id range. Reads a database in parallel when `df` comes from `read_id_ranges`."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])
    chunks = id_chunks(df, id_column, condition, columns, size).select("chunk", line.alias("value"))
    write_shards(chunks, path, mode, "chunk")


def read_id_ranges(spark: SparkSession, url: str, table: str, id_column: str, last: int, ranges: int, **options) -> DataFrame:
    """A database table read in parallel id ranges."""
    return spark.read.jdbc(
        url, table, column=id_column, lowerBound=0, upperBound=last, numPartitions=ranges, properties=options
    )
