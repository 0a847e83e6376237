"""Lists of files: what is there, how large it is, what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_manifest(spark: SparkSession, path: str, suffix: str = "", prefix: str = "") -> DataFrame:
    """`path, length, modificationTime` of the files whose name ends and whose path starts so; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return chosen_files(files.select("path", "length", "modificationTime"), suffix, prefix)


def chosen_files(files: DataFrame, suffix: str = "", prefix: str = "") -> DataFrame:
    """The listed files whose path starts and ends so, in the order of their paths."""
    return files.where(F.col("path").endswith(suffix) & F.col("path").startswith(prefix)).orderBy("path")


def path_sizes(files: DataFrame, group: Column) -> DataFrame:
    """Bytes per group and, in the row without a group, of everything; the total also in larger units."""
    totals = files.select(group.alias("prefix"), "length").rollup("prefix").agg(
        F.grouping("prefix").alias("is_total"), F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("bytes")
    )
    units = {"kB": 1e3, "MB": 1e6, "GB": 1e9, "TB": 1e12}
    return totals.select(
        F.when(F.col("is_total") == 1, "Total").otherwise(F.col("prefix")).alias("prefix"),
        "bytes",
        *[(F.col("bytes") / size).alias(unit) for unit, size in units.items()],
    )


def manifest_ids(files: DataFrame, path: str = "path") -> DataFrame:
    """Give every file the md5 of its path as id."""
    return files.withColumn("id", F.md5(F.col(path)))


def new_files(files: DataFrame, taken: DataFrame, path: str = "path") -> DataFrame:
    """Files whose id is not in the stored manifest."""
    return manifest_ids(files, path).join(taken.select("id"), "id", "left_anti")


def incremental_manifest(files: DataFrame, store: str, path: str = "path") -> DataFrame:
    """Append the files not yet in the manifest at `store` and return the manifest."""
    spark = files.sparkSession
    files = manifest_ids(files, path)
    # an empty append creates the store on the first run
    files.limit(0).write.mode("append").parquet(store)
    new_files(files, spark.read.parquet(store), path).select(*files.columns).write.mode("append").parquet(store)
    return spark.read.parquet(store)
