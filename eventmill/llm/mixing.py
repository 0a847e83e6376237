"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.llm.common import fresh, offsets, ordered, ranked, saved, text_of, words_in

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """`source, source_size, target` from rows of `source, size`.

    The sources, by code point and NULL last, weigh as `weights` repeated. They divide `share` of all sizes by weight; no
    target goes above `most` times its source's size, and the rest is divided again among the others.
    """
    sources = saved(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    rows = ordered(sources, [F.col("source").isNull(), F.col("source")], "sources-in-order")
    cycle = F.array(*[F.lit(w) for w in weights])
    known = saved(
        ranked(rows, offsets(rows)).select(
            "source", "source_size", (F.col("source_size") * most).alias("cap"), F.get(cycle, F.col("rank") % len(weights)).alias("weight")
        ),
        "source-weights",
    )
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:  # each round stops at least one more source
        above = F.col("weight") * F.lit(level) > F.col("cap") if stopped >= 0 else F.lit(False)
        caps, free, n = known.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.count(F.when(above, 1))
        ).first()
        if n == stopped or not free:
            break
        level, stopped = (total * share - caps) / free, n
    return known.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target")
    )


def random_offset(source: Column, seed: str) -> Column:
    """A number from 0 to 1 that depends on the seed and the source only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(2.0**32)


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix", texts: bool = False
) -> DataFrame:
    """`doc_id, source` (with `texts`: all columns) and `size` (words), `source_size`, `target` (of the source) and `copies` (how often the mix takes the row).

    All rows of a source have the same expected number of copies, target / source_size. Within a source, rows stand by
    size and doc_id, their expected copies are summed up, one random offset per source is added, and a row is taken once
    for every whole number that its stretch crosses. As rows of like size stand together, the words taken come as near to
    the target as one large row. `copies` is at most `most`.

    NULL texts have size 0; NULL sources are a source of their own, the last; a source without words has target 0 and no
    copies. Repeated rows are taken one by one. An empty table gives an empty table. The order of a large source is cut
    over many tasks. Columns of the input with the names of the result are replaced.
    """
    taken = ("size", "source_size", "target", "copies")
    keep = [c for c in docs.columns if c.lower() not in taken] if texts else ["doc_id", "source"]
    (null,) = fresh(docs, "_null")
    sized = docs.select(*[F.col(f"`{c}`") for c in keep], words_in(text_of(docs)).alias("size"))
    if not texts:
        sized = saved(sized, "mix-sizes")
    rows = ordered(
        sized.withColumn(null, F.col("source").isNull()), [F.col(null), F.col("source"), F.col("size"), F.col("doc_id")], "mix-in-order"
    )
    targets = source_targets(rows.select("source", "size"), weights, share, most)
    starts = offsets(rows, ["source"])
    named = targets.withColumnRenamed("source", "of")
    table = starts.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = random_offset(F.col("source"), seed)
    copies = F.floor((F.col("rank") + 1) * each + offset) - F.floor(F.col("rank") * each + offset)
    return ranked(rows, table, ["source"]).select(*[F.col(f"`{c}`") for c in keep], "size", "source_size", "target", copies.alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    (copy,) = fresh(docs, "_copy")
    mixed = mix_sources(docs, texts=True, **options).where("copies > 0")
    return mixed.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy)).select(*columns)
