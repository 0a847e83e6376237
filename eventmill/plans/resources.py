"""Jobs over course resources: export of items, problem pages to text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.functions.json_text import as_text
from eventmill.functions.plain_text import ascii_fold
from eventmill.operators.pages import pages_to_text


def export_resources(df: DataFrame, category: str) -> DataFrame:
    """`(id, data, metadata)` of the items of a category.

    Items have `_id` (tag, org, course, name, category), `definition.data` as variant and `metadata` as variant. The
    body is `definition.data`, or the `data` inside it; what is no string is given as JSON text.
    """
    item = F.concat_ws(".", *[F.coalesce(F.col(f"_id.{part}"), F.lit("None")) for part in ("tag", "org", "course", "name", "category")])
    body = F.col("definition.data")
    inner = F.coalesce(F.try_variant_get(body, "$.data", "variant"), body)
    return df.where(F.col("_id.category") == category).select(
        F.replace(item, F.lit("/"), F.lit("_")).alias("id"),
        F.coalesce(as_text(inner), F.to_json(inner)).alias("data"),
        F.to_json("metadata").alias("metadata"),
    )


def problems_to_text(df: DataFrame, key: str = "page_id", html: str = "html", **options) -> DataFrame:
    """Plain ASCII text of a collection of HTML problems."""
    return pages_to_text(df.withColumn(html, ascii_fold(F.col(html))), key, html, **options)
