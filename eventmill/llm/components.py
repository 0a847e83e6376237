"""Connected components by joins; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.llm.common import saved


def connected_components(links: DataFrame) -> DataFrame:
    """`id, component` for links `a, b`: the smallest id that links lead to.

    In each round an id takes the least label of itself and its neighbours, and then the label of its label, so that the
    rounds grow with the logarithm of the longest way rather than with its length. A round's labels are a saved table; they are
    done when no link leads from one label to another. Every round reads `links`, so they should be a saved table, too.
    Links that hold NULL and links of an id with itself change nothing.
    """
    known = links.where("a IS NOT NULL AND b IS NOT NULL")
    both = known.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("of")).select("of.*")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        taken = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "near").alias("component"))
        further = labels.select(F.col("id").alias("of"), F.col("component").alias("next"))
        labels = saved(
            taken.join(further, F.col("component") == F.col("of")).select("id", F.least("component", "next").alias("component")),
            "labels",
        )
        a, b = (labels.select(F.col("id").alias(x), F.col("component").alias(f"{x}_component")) for x in "ab")
        if known.join(a, "a").join(b, "b").where("a_component <> b_component").isEmpty():
            return labels
