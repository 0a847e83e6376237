"""Text lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.functions.json_text import ascii_only, record_text
from eventmill.operators.parse import parse_events
from eventmill.sources.by_content import RAW_GZIP, SCHEMA, lines_of_pieces


def read_lines(
    spark: SparkSession, path: str, only_gz: bool = False, ascii: bool = True, file_column: str | None = None,
    streaming: bool = False, by_content: bool = False,
) -> DataFrame:
    """`value` per line of all files below the path. Compressed files are read by their suffix.

    With `by_content`, a file named `.gz` is unpacked only if it begins as gzip files do, and read as plain text else. Files
    are unpacked piece by piece in the tasks, so none is too large; it costs more than going by the name.
    """
    reader = (spark.readStream if streaming else spark.read).option("recursiveFileLookup", True)
    if only_gz:
        reader = reader.option("pathGlobFilter", "*.gz")
    if by_content:
        raw = reader.options(**RAW_GZIP).text(path)
        where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
        lines = raw.select(F.col("value").cast("binary").alias("raw"), *where).mapInArrow(lines_of_pieces, SCHEMA)
        lines = lines.select("value", *([F.col("file").alias(file_column)] if file_column else []))
        return lines.withColumn("value", ascii_only(F.col("value"))) if ascii else lines
    # .text() wants the schema `value` only
    lines = reader.text(path)
    if file_column:
        lines = lines.select("value", F.col("_metadata.file_path").alias(file_column))
    return lines.withColumn("value", ascii_only(F.col("value"))) if ascii else lines


#: Pieces a core gets of rows that are spread: tasks stay short, and a slow one holds up little.
PIECES = 4


def spread(df: DataFrame) -> DataFrame:
    """Shuffle rows evenly when they come in fewer pieces than there is work for, as from a few large gzip files.

    Meant for plain lines, in front of costly work; input in many pieces stays as it is.
    """
    pieces = PIECES * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(pieces) if df.rdd.getNumPartitions() < pieces else df


def read_json_events(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines parsed to records."""
    return parse_events(read_lines(spark, path, **options))


def split_delimited(df: DataFrame, delimiter: str = "\t", column: str = "value") -> DataFrame:
    """`fields`, the plain split of each line: quotes mean nothing."""
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return df.select(F.split(column, quoted).alias("fields"))


def read_delimited(spark: SparkSession, path: str, delimiter: str = "\t", **options) -> DataFrame:
    return split_delimited(read_lines(spark, path, **options), delimiter)


def as_json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row: of the record when there is one, else of all columns."""
    document = record_text(F.col("rec")) if "rec" in df.columns else F.to_json(F.struct("*"))
    return df.select(document.alias("value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    as_json_lines(df).write.mode(mode).text(path)


def save_events(df: DataFrame, path: str, most: int = 20000, mode: str = "errorifexists") -> None:
    """Lines as gzip parts of at most that many rows."""
    lines = df if df.columns == ["value"] else as_json_lines(df)
    lines.write.mode(mode).option("maxRecordsPerFile", most).option("compression", "gzip").text(path)
