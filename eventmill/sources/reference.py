"""Reference tables from delimited files, published as views or tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.functions.country_facts import COLUMN_KINDS, NOT_NATIONS
from eventmill.operators.filters import exclude_list
from eventmill.operators.joins import lookup_join
from eventmill.operators.tables import clean_column_names, parse_typed_columns


def read_languages(spark: SparkSession, path: str, name: str = "name", value: str = "language_list") -> DataFrame:
    """Names and texts, tab-separated without header."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias(name), F.get(parts, F.lit(1)).alias(value))


def _windows_marks() -> tuple[str, str]:
    """The control characters of Latin-1 that are marks in windows-1252, which Spark has no reader for."""
    pairs = [(chr(code), bytes([code]).decode("cp1252", "ignore")) for code in range(0x80, 0xA0)]
    return "".join(c for c, mark in pairs if mark), "".join(mark for _, mark in pairs)


def load_reference_table(
    spark: SparkSession,
    path: str,
    languages: DataFrame,
    kinds: dict[str, str] = COLUMN_KINDS,
    excluded: list[str] = NOT_NATIONS,
    encoding: str = "UTF-8",
    view: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """CSV with header: names cleaned, columns typed, excluded names dropped, one text per name looked up.

    The first column is the name; `languages` holds `(name, language_list)`.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    windows = encoding.lower() in ("windows-1252", "cp1252")
    raw = clean_column_names(reader.option("encoding", "ISO-8859-1" if windows else encoding).csv(path))
    if windows:
        raw = raw.select(*[F.translate(F.col(f"`{c}`"), *_windows_marks()).alias(c) for c in raw.columns])
    name = raw.columns[0]
    kept = parse_typed_columns(exclude_list(raw, name, excluded), kinds)
    table = lookup_join(kept, languages.withColumnRenamed(languages.columns[0], name), name, languages.columns[1], strict)
    if view:
        table.createOrReplaceTempView(view)
    return table


def publish_table(df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None) -> None:
    """Replace a table of the session catalog, in its warehouse folder or at a given path."""
    writer = df.write.mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def publish_to_database(df: DataFrame, url: str, name: str, **options) -> None:
    """Replace a table of a database."""
    df.write.mode("overwrite").jdbc(url, name, properties=options)
