"""Exact search for the largest inner products: long vectors first, bounds from partial sums after a rotation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.llm.common import saved

BLOCK, QUERY_BLOCK, SEED_BLOCKS, LANES = 2048, 256, 2, 32
#: Sums of products below this are exact in double precision.
_EXACT = 2.0**53

_BLOCK = "dim int, longest double, ids binary, vectors binary"
_BLOCK_ARROW = pa.schema([("dim", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())])


def scaled_vectors(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """`vec_id, v, norm`: whole numbers floor(scale * x) as doubles. Rows without id or with an unusable vector go."""
    x = F.col(f"`{column}`")
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double"))
    # floor() gives a long; components too large for one are whole already
    exact = F.transform(x, lambda c: F.lit(float(scale)) * c.cast("double"))
    huge = F.exists(x, lambda c: F.abs(c.cast("double")) >= 2.0**52 / scale)
    v = F.when(huge, exact).otherwise(whole)
    rows = df.where(F.col(f"`{id_column}`").isNotNull() & F.coalesce(usable, F.lit(False)))
    rows = rows.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)))


def _packer(rows_per_block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []

        def block():
            matrix = np.stack(vectors)
            longest = float(np.sqrt((matrix**2).sum(1).max()))
            data = [[matrix.shape[1]], [longest], [np.array(ids, "<i8").tobytes()], [matrix.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(data, _BLOCK_ARROW, strict=True)], schema=_BLOCK_ARROW)

        for batch in batches:
            lists = batch.column("v")
            offsets, flat = lists.offsets.to_numpy(), np.asarray(lists.values, dtype="<f8")
            for k, i in enumerate(batch.column("vec_id").to_pylist()):
                v = flat[offsets[k] : offsets[k + 1]]
                if ids and (len(ids) == rows_per_block or len(v) != len(vectors[0])):
                    yield block()
                    ids, vectors = [], []
                ids.append(i)
                vectors.append(v)
        if ids:
            yield block()

    return pack


def _matrix(dim: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, dim)


def rotations(blocks: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions, the right singular vectors of all vectors, the strongest first.

    They are the eigenvectors of the sum of all outer products; a task gives one such matrix per dimension.
    """

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, data in zip(batch.column("dim").to_pylist(), batch.column("vectors").to_pylist(), strict=True):
                m = _matrix(dim, data)
                m = m / max(1.0, np.abs(m).max())
                sums[dim] = sums.get(dim, 0) + m.T @ m
        for dim, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["dim", "gram"])

    totals: dict[int, np.ndarray] = {}
    for row in blocks.select("dim", "vectors").mapInArrow(gram, "dim int, gram binary").toLocalIterator():
        totals[row["dim"]] = totals.get(row["dim"], 0) + _matrix(row["dim"], row["gram"])
    return {dim: np.linalg.eigh(total)[1][:, ::-1] for dim, total in totals.items()}


def _best(scores: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int):
    """The k best finite scores of each row, ties to the smaller id."""
    kth = np.partition(scores, -min(k, scores.shape[1]), axis=1)[:, -min(k, scores.shape[1])]
    q, c = np.nonzero((scores >= kth[:, None]) & (scores > -np.inf))
    s = scores[q, c]
    order = np.lexsort((c_ids[c], -s, q))
    q, c, s = q[order], c[order], s[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q_ids[q[keep]], c_ids[c[keep]], s[keep]


def block_scores(q: np.ndarray, c: np.ndarray, rotation: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Inner products of queries and candidates; -inf where a bound shows that they are below the query's floor.

    A block whose longest vector cannot reach the floor is left out. Then the leading dimensions after the rotation give
    partial sums; what the rest can add is at most the product of the lengths of both rests (Cauchy and Schwarz).
    """
    q_norm, c_norm = np.sqrt((q**2).sum(1)), np.sqrt((c**2).sum(1))
    scores = np.full((len(q), len(c)), -np.inf)
    slack = 1e-9 * max(1.0, float(q_norm.max() * c_norm.max()))
    live = np.flatnonzero(q_norm * c_norm.max() + slack >= floor)
    if not len(live):
        return scores
    if q_norm.max() * c_norm.max() >= _EXACT:
        exact = [[int(x) for x in row] for row in c.tolist()]
        for i in live:
            row = [int(x) for x in q[i].tolist()]
            scores[i] = [float(sum(a * b for a, b in zip(row, other, strict=True))) for other in exact]
        return scores
    w = max(1, q.shape[1] // 4)
    qr, cr = q[live] @ rotation, c @ rotation
    rest = np.sqrt((qr[:, w:] ** 2).sum(1))[:, None] * np.sqrt((cr[:, w:] ** 2).sum(1))[None]
    open_ = qr[:, :w] @ cr[:, :w].T + rest + slack >= floor[live][:, None]
    columns = np.flatnonzero(open_.any(axis=0))
    if len(columns):
        scores[np.ix_(live, columns)] = np.where(open_[:, columns], q[live] @ c[columns].T, -np.inf)
    return scores


def _search(k: int, turn: dict[int, np.ndarray]):
    names = ["query_id", "vec_id", "score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                q_ids, c_ids = np.frombuffer(x["q_ids"], "<i8"), np.frombuffer(x["ids"], "<i8")
                floor = np.frombuffer(x["q_floor"], "<f8")
                scores = block_scores(_matrix(x["dim"], x["q_vectors"]), _matrix(x["dim"], x["vectors"]), turn[x["dim"]], floor)
                scores[q_ids[:, None] == c_ids[None]] = -np.inf
                found = _best(scores, q_ids, c_ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in found], names=names)

    return search


def _pairs(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every query block beside every candidate block of its dimension, spread over lanes."""
    lanes = F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane")
    q = queries.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "q_floor", lanes)
    c = blocks.withColumn("c_lane", F.pmod(F.xxhash64("ids"), F.lit(LANES)).cast("int"))
    return c.join(q, (F.col("dim") == F.col("q_dim")) & (F.col("c_lane") == F.col("lane"))).select(
        "dim", "ids", "vectors", "q_ids", "q_vectors", "q_floor"
    )


def _with_floor(block: DataFrame) -> DataFrame:
    """Query blocks whose floor still is open: anything counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [np.full(len(i) // 8, -np.inf).tobytes() for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.binary())], names=[*batch.schema.names, "q_floor"])

    return block.mapInArrow(add, f"{_BLOCK}, q_floor binary")


def _raise_floor(queries: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Query blocks with the k-th best score that the longest vectors gave; -inf where they gave fewer."""
    per_query = seeds.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    known = per_query.select("query_id", F.get("s", F.lit(k - 1)).alias("low")).where("low IS NOT NULL")
    keyed = queries.drop("q_floor").withColumn("block", F.sha2("ids", 256))
    members = keyed.select("block", "ids").mapInArrow(_members, "block string, place int, id bigint")
    lows = (
        members.join(known, F.col("id") == F.col("query_id"), "left")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("low", F.lit(float("-inf"))).alias("low")))).alias("lows"))
    )
    joined = keyed.join(lows, "block").select("dim", "longest", "ids", "vectors", F.col("lows.low").alias("low"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [np.array(x, "<f8").tobytes() for x in batch.column("low").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(low, pa.binary())], names=[*batch.schema.names[:4], "q_floor"])

    return joined.mapInArrow(pack, f"{_BLOCK}, q_floor binary")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            ids_ = np.frombuffer(ids, "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(ids_)), pa.array(np.arange(len(ids_), dtype="i4")), pa.array(ids_)], names=["block", "place", "id"]
            )


def top_products(df: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """`query_id, rank, vec_id, score`: for the rows that `is_query` picks, the k other rows of the largest inner product.

    Exact for whole numbers floor(scale * x); ties go to the smaller id, scores beyond a long stop at its ends. Vectors
    that are NULL, empty, or hold NULL or a non-finite number take no part, nor do rows without id; vectors of different
    lengths are not compared. Rows with the query's id are its own; if a query id repeats, its least vector is the query.
    Other repeated rows count each. Fewer than k candidates give fewer rows, an empty table none.

    Candidates are cut by length into blocks, the longest first. The two longest blocks give each query a floor, and the
    other blocks are searched against it. A pair of blocks is a unit of work; no query or candidate set is whole anywhere.
    """
    picked = df.where(F.coalesce(is_query, F.lit(False)))
    vectors = scaled_vectors(df, id_column, column, scale)
    order = [F.size("v"), F.col("norm").desc(), F.col("vec_id")]
    cut = vectors.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "v")
    blocks = saved(cut.mapInArrow(_packer(BLOCK), _BLOCK), "topk-blocks")
    # one row per query id
    own = scaled_vectors(picked, id_column, column, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    by_size = own.repartitionByRange(F.size("v"), F.col("vec_id")).sortWithinPartitions(F.size("v"), "vec_id")
    queries = saved(_with_floor(by_size.mapInArrow(_packer(QUERY_BLOCK), _BLOCK)), "topk-queries")
    turn = rotations(blocks)
    search, result = _search(k, turn), "query_id bigint, vec_id bigint, score double"
    first = Window.partitionBy("dim").orderBy(F.col("longest").desc(), F.sha2("ids", 256))
    heads = blocks.select("dim", "longest", "ids").withColumn("n", F.row_number().over(first)).where(F.col("n") <= SEED_BLOCKS).select("ids")
    seeds = saved(_pairs(queries, blocks.join(heads, "ids", "left_semi")).mapInArrow(search, result), "topk-seeds")
    aimed = saved(_raise_floor(queries, seeds, k), "topk-aimed")
    rest = _pairs(aimed, blocks.join(heads, "ids", "left_anti")).mapInArrow(search, result)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = seeds.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    end = 2.0**63
    score = F.when(F.col("score") >= end, F.lit(2**63 - 1)).when(F.col("score") <= -end, F.lit(-(2**63))).otherwise(F.col("score").cast("long"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
