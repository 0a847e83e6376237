"""Helpers of the corpus operators: saved tables, ordinals without a single task, words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.session import bound_buffers, scratch_path

#: A word is a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    bound_buffers(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, NULL as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ordered(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """Rows cut by ranges of `order` and sorted in them, saved with `_part` and `_seq`, which follow that order.

    Rows of a frequent key span many parts, as long as `order` ends in something that tells rows apart.
    """
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(cut.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")), label)


def offsets(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """For each part and group: `_first` (its first `_seq`) and `_before` (rows of the group in earlier parts).

    One row per part and group that meet, so not more than parts and groups together; the window of a group holds as
    many rows as there are parts.
    """
    from pyspark.sql import Window

    runs = rows.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("_part", *group, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))


def ranked(rows: DataFrame, table: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """`ordered` rows joined with a table made from their `offsets`; adds `rank`, from 0, within the group."""
    keys = ["_part", *group]
    other = table.select(*[F.col(f"`{c}`").alias(f"{c}:of") for c in table.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & rows[key].eqNullSafe(other[f"`{key}:of`"])
    own = [F.col(f"`{c}`") for c in rows.columns if c not in ("_part", "_seq")]
    extra = [F.col(f"`{c}:of`").alias(c) for c in table.columns if c not in ("_first", "_before", *keys)]
    return rows.join(other, condition).select(
        *own, *extra, (F.col("`_before:of`") + F.col("_seq") - F.col("`_first:of`")).alias("rank")
    )


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that are not among the columns, so that extra columns do no harm."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """The schema with fields added; those of the same name are replaced."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + list(fields))
