"""Hard negatives: rows of another label that score high, but clearly lower than the anchor's own positives."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.llm.common import saved
from eventmill.llm.str_tree import FOUND, QUERIES, meet, packed, searcher

_LONG = 2**63 - 1
_BLOCK = "dim int, label string, low array<double>, high array<double>, ids binary, vectors binary, windows binary, least double, most double"


def labelled_vectors(df: DataFrame, label: Column, id_column: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """`vec_id, label, v` of the rows that take part, components as whole numbers floor(scale * x) in doubles."""
    x = F.transform(F.col(f"`{column}`"), lambda c: F.lit(float(scale)) * c.cast("double"))
    usable = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # numbers this large are whole already, and floor() gives a long
    whole = F.transform(x, lambda c: F.when(F.abs(c) >= 2.0**52, c).otherwise(F.floor(c).cast("double")))
    known = F.col(f"`{id_column}`").isNotNull() & label.isNotNull() & F.coalesce(usable, F.lit(False))
    return df.where(known).select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), label.cast("string").alias("label"), whole.alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []

    def block() -> pa.RecordBatch:
        v = np.array([r["v"] for r in rows], "<f8")
        windows = np.zeros((len(rows), max(len(r["lows"]) for r in rows), 2), "<i8")
        windows[..., 0] = 1  # nothing lies between 1 and 0
        for i, r in enumerate(rows):
            windows[i, : len(r["lows"]), 0], windows[i, : len(r["lows"]), 1] = r["lows"], r["highs"]
        real = windows[windows[..., 0] <= windows[..., 1]]
        least, most = (float(real[:, 0].min()), float(real[:, 1].max())) if len(real) else (1.0, 0.0)
        ids = np.array([r["vec_id"] for r in rows], "<i8")
        return pa.RecordBatch.from_pylist([{
            "dim": v.shape[1], "label": rows[0]["label"], "low": v.min(0).tolist(), "high": v.max(0).tolist(), "ids": ids.tobytes(),
            "vectors": v.tobytes(), "windows": windows.tobytes(), "least": least, "most": most,
        }], schema=pa.schema([
            ("dim", pa.int32()), ("label", pa.string()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.binary()),
            ("vectors", pa.binary()), ("windows", pa.binary()), ("least", pa.float64()), ("most", pa.float64()),
        ]))

    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            if rows and (len(rows) == QUERIES or row["label"] != rows[0]["label"] or len(row["v"]) != len(rows[0]["v"])):
                yield block()
                rows = []
            rows.append(row)
    if rows:
        yield block()


def _query_blocks(anchors: DataFrame) -> DataFrame:
    """Blocks of anchors `vec_id, label, v, lows, highs` of one length and one label, near ones together."""
    group = [F.size("v"), F.col("label"), F.get("v", F.lit(0)), F.col("vec_id")]
    cut = anchors.repartitionByRange(*group).sortWithinPartitions(*group)
    return cut.select("vec_id", "label", "v", "lows", "highs").mapInArrow(_blocks, _BLOCK)


def _searched(anchors: DataFrame, nodes: DataFrame, k: int, same_label: bool, label: str) -> DataFrame:
    """`query_id, slot, vec_id, score, rank`: the k best of each anchor and window."""
    blocks = saved(_query_blocks(anchors), f"{label}-blocks")
    # as many lanes as keep both the copies of the queries and the nodes of a lane few
    lanes = max(1, math.ceil(2 * math.sqrt(nodes.count())))
    found = saved(meet(blocks, nodes, lanes, same_label).mapInArrow(searcher(k), FOUND), f"{label}-found")
    best = Window.partitionBy("query_id", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine_hard_negatives(
    df: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_column: str = "vec_id", column: str = "embedding", scale: int = 256,
) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score`.

    Scores are inner products of floor(scale * x), whole numbers; higher ones come first, ties by the smaller id. An
    anchor's positives are its first rows of the same label (all, if fewer). For each positive, the negatives are the first
    rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score; where there are none,
    as for positives below 0, there is no row.

    Rows take no part if id, label or vector is NULL, or the vector is empty or holds NULL or a component that is not
    finite after scaling. Vectors of different lengths are not compared. Rows with the anchor's id are its own; if an
    anchor's id repeats, its least (label, vector) is the anchor. Other repeated rows count each. Scores beyond 64 bits
    stop at the ends. An empty table gives no rows; other columns are ignored.

    Vectors are packed into boxes in sort-tile-recursive order, each of one label. A box and an anchor bound the inner
    products by an interval per coordinate; best-first search opens the box with the greatest bound and leaves out those
    outside all windows or strictly below the k-th score. Blocks of anchors meet nodes lane by lane, and boxes that miss
    all windows of a block are left out by the join. Nothing is gathered by label, anchor or task.
    """
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = saved(labelled_vectors(df, label, id_column, column, scale), "negatives-rows")
    picked = labelled_vectors(df.where(F.coalesce(is_anchor, F.lit(False))), label, id_column, column, scale)
    own = picked.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("own")).select("vec_id", "own.label", "own.v")
    nodes = saved(packed(rows), "negatives-nodes")
    whole = own.select("*", F.array(F.lit(-_LONG)).alias("lows"), F.array(F.lit(_LONG)).alias("highs"))
    first = saved(_searched(whole, nodes, positives, True, "positives").select(
        F.col("query_id").alias("anchor_id"), (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
    ), "positives")
    p = F.col("positive_score").cast("decimal(20,0)")
    end = lambda c: F.greatest(F.least(c, F.lit(_LONG)), F.lit(-_LONG)).cast("long")
    windows = first.select("anchor_id", F.struct("slot", end(F.ceil(p * low / 100)).alias("low"), end(F.floor(p * high / 100)).alias("high")).alias("w"))
    windows = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    aimed = own.join(windows, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    found = _searched(aimed, nodes, negatives, False, "negatives")
    return found.join(first, (F.col("query_id") == F.col("anchor_id")) & (found["slot"] == first["slot"])).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
