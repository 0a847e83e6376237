"""Approximate nearest neighbours: a graph built by NN-descent in Spark joins, searched greedily from many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.llm.common import saved

NEIGHBOURS, SAMPLE, ROUNDS = 32, 10, 7
BEAM, EXPANDED, HOPS = 256, 64, 6
ORDERS, CODE_BITS, RUN = 2, 12, 256


def _usable(x: Column) -> Column:
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda c: c != 0)


def _rows(column: pa.Array, kind: str) -> np.ndarray:
    """A matrix from binary cells of equal length."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _coded(vectors: DataFrame, scale: float, seed: int) -> DataFrame:
    """`id, x` (double bytes), `q` (float bytes, scaled) and a sort key for each random order.

    With a scale that brings usual vectors to about 1, only components 1e38 times as large are clipped.
    """
    most = float(np.finfo(np.float32).max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.asarray(batch.column("v").flatten(), dtype="<f8").reshape(batch.num_rows, -1)
            q = np.clip(m * scale, -most, most).astype(np.float32)
            keys = []
            for t in range(ORDERS):
                planes = np.random.default_rng(seed + t).normal(size=(m.shape[1], CODE_BITS))
                side = q.astype(np.float64) @ planes
                keys.append(pa.array(((side > 0) * (1 << np.arange(CODE_BITS - 1, -1, -1))).sum(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([r.tobytes() for r in m], pa.binary()), pa.array([r.tobytes() for r in q], pa.binary()), *keys],
                names=["id", "x", "q", *[f"key{t}" for t in range(ORDERS)]],
            )

    keys = ", ".join(f"key{t} bigint" for t in range(ORDERS))
    return vectors.mapInArrow(run, f"id bigint, x binary, q binary, {keys}")


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """About the squared distances between the rows of two matrices (or of stacks of them)."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a**2).sum(-1)[..., :, None] + (b**2).sum(-1)[..., None, :] - 2 * np.matmul(a, np.swapaxes(b, -1, -2))


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows: a pair has the same number wherever it is measured, in either order."""
    out = np.empty(len(a))
    for at in range(0, len(a), 4096):
        part = slice(at, at + 4096)
        out[part] = ((a[part].astype(np.float64) - b[part].astype(np.float64)) ** 2).sum(1)
    return out


_EDGE = "u bigint, v bigint, d double"


def _edges(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d.astype(np.float64))], names=["u", "v", "d"])


def _run_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nearest within runs of `RUN` rows of a random order: where the descent starts."""
    ids: list[int] = []
    cells: list[bytes] = []

    def run() -> pa.RecordBatch:
        i, q = np.array(ids), np.frombuffer(b"".join(cells), np.float32).reshape(len(ids), -1)
        d = _squared(q, q)
        np.fill_diagonal(d, np.inf)
        k = min(NEIGHBOURS // ORDERS + 4, len(i) - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(i), 0), int)
        a, b = np.repeat(np.arange(len(i)), k), near.ravel()
        return _edges(i[a], i[b], _between(q[a], q[b]))

    for batch in batches:
        for i, q in zip(batch.column("id").to_pylist(), batch.column("q").to_pylist(), strict=True):
            ids.append(i)
            cells.append(q)
            if len(ids) == RUN:
                yield run()
                ids, cells = [], []
    if len(ids) > 1:
        yield run()


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each `u`; of repeated edges the old one stays. Columns `u, v, d, fresh`."""
    by = Window.partitionBy("u").orderBy("d", "v", "fresh")
    once = edges.withColumn("before", F.lag("v").over(by)).where("before IS NULL OR before <> v")
    return once.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).select("u", "v", "d", "fresh")


def _sampled(edges: DataFrame, node: str, turn: int) -> DataFrame:
    by = Window.partitionBy(node, "fresh").orderBy(F.xxhash64("u", "v", F.lit(turn)))
    return edges.withColumn("place", F.row_number().over(by)).where(F.col("place") <= SAMPLE).drop("place")


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the members of each centre, at least one of a pair fresh; gives what is nearer than a member's farthest."""
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            lists = batch.column("members")
            counts = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            if not len(flat):
                continue
            ids = flat.field("m").to_numpy(zero_copy_only=False)
            isnew = flat.field("fresh").to_numpy(zero_copy_only=False).astype(bool)
            far = flat.field("far").to_numpy(zero_copy_only=False)
            q = _rows(flat.field("q"), "<f4")
            width = int(counts.max())
            slot = np.full((len(counts), width), -1)
            slot[np.arange(width)[None] < counts[:, None]] = np.arange(len(ids))
            have = slot >= 0
            d = _squared(q[slot], q[slot])
            pair = have[:, :, None] & have[:, None, :] & (isnew[slot][:, :, None] | isnew[slot][:, None, :])
            pair &= ids[slot][:, :, None] != ids[slot][:, None, :]
            pair &= d < far[slot][:, :, None]
            g, a, b = np.nonzero(pair)
            if len(g):
                i, j = slot[g, a], slot[g, b]
                u, v = ids[i], ids[j]
                _, once = np.unique(np.stack([u, v]), axis=1, return_index=True)
                yield _edges(u[once], v[once], _between(q[i[once]], q[j[once]]))


def neighbour_graph(nodes: DataFrame, k: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """NN-descent: `u, v, d` with about the k nearest nodes of each, for `nodes` of `id, q` and random order keys.

    A round takes some fresh and old neighbours of every node in both directions, joins them to the node, and compares
    the neighbours with each other: two neighbours of a node are likely near. Lists are cut to the nearest k. Samples,
    lists and the members at a node are bounded by parameters, so a node that is near to very many is no burden.
    """
    starts = None
    for t in range(ORDERS):
        order = [F.col(f"key{t}"), F.xxhash64("id", F.lit(t))]
        found = nodes.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "q").mapInArrow(_run_neighbours, _EDGE)
        starts = found if starts is None else starts.union(found)
    edges = saved(_nearest(starts.withColumn("fresh", F.lit(True)), k), "graph")
    for turn in range(rounds):
        chosen = _sampled(edges, "u", turn)
        back = _sampled(chosen.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh"), "u", turn)
        members = chosen.select("u", "v", "fresh").union(back.select("u", "v", "fresh"))
        members = members.groupBy(F.col("u").alias("centre"), F.col("v").alias("m")).agg(F.max("fresh").alias("fresh"))
        far = edges.groupBy(F.col("u").alias("id")).agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("n"))
        info = nodes.select("id", "q").join(far, "id", "left").select("id", "q", F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf"))).alias("far"))
        placed = members.join(info, members["m"] == info["id"]).groupBy("centre").agg(F.collect_list(F.struct("m", "fresh", "far", "q")).alias("members"))
        found = placed.select("members").mapInArrow(_local_join, _EDGE)
        used = chosen.where("fresh").select("u", "v", F.lit(True).alias("used"))
        old = edges.join(used, ["u", "v"], "left").select("u", "v", "d", (F.col("fresh") & F.col("used").isNull()).alias("fresh"))
        edges = saved(_nearest(old.union(found.withColumn("fresh", F.lit(True))), k), "graph")
    return edges.select("u", "v", "d")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            d = _between(_rows(batch.column("a"), "<f4"), _rows(batch.column("b"), "<f4"))
            yield _edges(batch.column("u").to_numpy(), batch.column("v").to_numpy(), d)


def greedy_search(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """`u, v, d`: the beam of each node `u` of `starts` after a greedy walk through the graph.

    A walk starts at the node's own neighbours. In each hop the nearest nodes of its beam that were not looked at give
    their neighbours, which are measured and join the beam.
    """
    beam = saved(edges.join(starts, "u", "left_semi").withColumn("done", F.lit(False)), "beam")
    own = nodes.join(starts.withColumnRenamed("u", "id"), "id", "left_semi").select(F.col("id").alias("of"), F.col("q").alias("a"))
    for _ in range(HOPS):
        near = Window.partitionBy("u").orderBy("d", "v")
        opened = beam.where("NOT done").withColumn("place", F.row_number().over(near)).where(F.col("place") <= EXPANDED)
        opened = saved(opened.select("u", "v"), "opened")
        if opened.isEmpty():
            break
        step = edges.select(F.col("u").alias("via"), F.col("v").alias("to"))
        next_ = opened.join(step, opened["v"] == step["via"]).where("u <> to").select("u", F.col("to").alias("v")).distinct()
        next_ = next_.join(beam.select("u", "v"), ["u", "v"], "left_anti")
        pairs = next_.join(nodes.select(F.col("id").alias("v"), F.col("q").alias("b")), "v").join(own, F.col("u") == F.col("of"))
        found = pairs.select("u", "v", "a", "b").mapInArrow(_measured, _EDGE).withColumn("done", F.lit(False))
        seen = beam.join(opened.withColumn("now", F.lit(True)), ["u", "v"], "left").select("u", "v", "d", (F.col("done") | F.col("now").isNotNull()).alias("done"))
        ranked = seen.union(found).withColumn("place", F.row_number().over(near)).where(F.col("place") <= BEAM)
        beam = saved(ranked.select("u", "v", "d", "done"), "beam")
    return beam.select("u", "v", "d")


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = _rows(batch.column("a"), "<f8"), _rows(batch.column("b"), "<f8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("v"), pa.array(np.sqrt(((a - b) ** 2).sum(1)))], names=["u", "v", "score"]
            )


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", column: str = "embedding", seed: int = 7) -> DataFrame:
    """`query_id, rank, vec_id, score`: for the rows that `is_query` picks, k rows that are about the nearest.

    `score` is the exact Euclidean distance in double precision; equal distances stand by id. Equal vectors are one node
    of the graph and come back as rows, the smallest ids first. Vectors that are NULL, empty, zero, or hold NULL or a
    non-finite number take no part, nor do rows without id and vectors of another length than most have. Rows with the
    query's id are its own; a query id that repeats counts with its least vector. Fewer than k candidates give fewer rows.
    """
    x = F.col(f"`{column}`")
    rows = df.where(F.col(f"`{id_column}`").isNotNull() & _usable(x))
    rows = rows.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), x.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").limit(1).collect()
    dim = dims[0]["dim"] if dims else 0
    rows = rows.where(F.size("v") == dim)
    usual = rows.agg(F.percentile_approx(F.array_max(F.transform("v", lambda c: F.abs(c))), 0.5, 1000)).first()[0] or 1.0
    keyed = saved(rows.withColumn("key", F.sha2(F.array_join(F.transform("v", lambda c: (c + F.lit(0.0)).cast("string")), ","), 256)), "vectors")
    least = Window.partitionBy("key").orderBy("vec_id")
    few = keyed.withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1)
    grouped = few.groupBy("key").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    # one number may name several vectors, so nodes get numbers of their own
    classes = saved(grouped.select("key", F.monotonically_increasing_id().alias("id"), "ids", "v"), "vector-classes")
    nodes = saved(_coded(classes.select("id", "v"), 1.0 / max(usual, 1e-300), seed), "nodes")
    edges = neighbour_graph(nodes)
    asks = keyed.where("asks").groupBy("vec_id").agg(F.min_by("key", "v").alias("key"))
    asks = saved(asks.join(classes.select("key", "id"), "key").select(F.col("vec_id").alias("query_id"), F.col("id").alias("u")), "queries")
    starts = asks.select("u").distinct()
    beam = greedy_search(edges, nodes, starts)
    near = Window.partitionBy("u").orderBy("d", "v")
    best = beam.withColumn("place", F.row_number().over(near)).where(F.col("place") <= 4 * k + 8).select("u", "v").union(starts.select("u", F.col("u").alias("v")))
    floats = nodes.select("id", "x")
    pairs = best.join(floats.select(F.col("id").alias("u"), F.col("x").alias("a")), "u").join(floats.select(F.col("id").alias("v"), F.col("x").alias("b")), "v")
    scored = pairs.select("u", "v", "a", "b").mapInArrow(_exact, "u bigint, v bigint, score double")
    spread = scored.join(classes.select(F.col("id").alias("v"), "ids"), "v").select("u", "score", F.explode("ids").alias("vec_id"))
    answers = asks.join(spread, "u").where("vec_id <> query_id")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
