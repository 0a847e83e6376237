"""Boxes around vectors, packed by sort-tile-recursive order, and best-first search in them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a leaf, most rows and bytes of a node, most queries of a block.
LEAF, NODE, NODE_BYTES, QUERIES = 64, 2048, 1 << 20, 128
#: The score of an empty place; no real score is that low.
NONE = -(2**63)
#: Sums of products below this are exact in double precision.
_EXACT = 2.0**53

_NODE = T.StructType([
    T.StructField("dim", T.IntegerType()), T.StructField("label", T.StringType()),
    T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("high", T.ArrayType(T.DoubleType())),
    T.StructField("ids", T.BinaryType()), T.StructField("vectors", T.BinaryType()),
])
_NODE_ARROW = pa.schema([
    ("dim", pa.int32()), ("label", pa.string()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
    ("ids", pa.binary()), ("vectors", pa.binary()),
])


def str_order(v: np.ndarray, first: int, leaf: int = LEAF) -> np.ndarray:
    """Order of the rows in which every `leaf` of them are one leaf: slabs by coordinate `first`, in them by the next."""
    if len(v) <= leaf or first >= v.shape[1]:
        return np.arange(len(v))
    leaves = -(-len(v) // leaf)
    last = first + 1 >= v.shape[1] or leaves <= 2
    slab = leaf if last else leaf * -(-leaves // max(2, int(np.ceil(np.sqrt(leaves)))))
    order = np.argsort(v[:, first], kind="stable")
    if last:
        return order
    return np.concatenate([p[str_order(v[p], first + 1, leaf)] for p in (order[i : i + slab] for i in range(0, len(order), slab))])


def _packer(most: int):
    """Rows `vec_id, label, v` in order to nodes of one length and one label each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        of: tuple | None = None

        def node() -> pa.RecordBatch:
            matrix, numbers = np.stack(vectors), np.array(ids, "<i8")
            # coordinates 0 and 1 have dealt the rows out already
            order = str_order(matrix, min(2, matrix.shape[1] - 1))
            data = [[of[0]], [of[1]], [matrix.min(0)], [matrix.max(0)], [numbers[order].tobytes()], [matrix[order].tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(data, _NODE_ARROW, strict=True)], schema=_NODE_ARROW)

        for batch in batches:
            lists = batch.column("v")
            ends, flat = lists.offsets.to_numpy(), np.asarray(lists.values, dtype="<f8")
            for k, (number, label) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                v = flat[ends[k] : ends[k + 1]]
                if ids and (of != (len(v), label) or len(ids) >= max(1, min(most, NODE_BYTES // (8 * len(v))))):
                    yield node()
                    ids, vectors = [], []
                of = (len(v), label)
                ids.append(number)
                vectors.append(v)
        if ids:
            yield node()

    return pack


def packed(rows: DataFrame, most: int = NODE) -> DataFrame:
    """Nodes `dim, label, low, high, ids, vectors` over rows `vec_id, label, v`.

    Ranges of the first coordinate are the slabs, rows of a slab are sorted by the second, runs of them are nodes, which
    the following coordinates cut into leaves. Rows with equal vectors are told apart by id, so no range takes them all.
    """
    group = [F.size("v"), F.col("label")]
    cut = rows.repartitionByRange(*group, F.get("v", F.lit(0)), F.col("vec_id"))
    cut = cut.sortWithinPartitions(*group, F.coalesce(F.get("v", F.lit(1)), F.lit(0.0)), F.col("vec_id"))
    return cut.select("vec_id", "label", "v").mapInArrow(_packer(most), _NODE)


def _extreme(q_low: str, q_high: str, low: str, high: str, greatest: bool) -> Column:
    """Bound of the inner products of two boxes: each coordinate adds its interval's end."""
    at = F.zip_with(F.zip_with(q_low, q_high, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                    F.zip_with(low, high, lambda c, d: F.struct(c.alias("c"), d.alias("d"))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def add(total: Column, p: Column) -> Column:
        ends = [p["x"][s] * p["y"][t] for s in "ab" for t in "cd"]
        return total + (F.greatest(*ends) if greatest else F.least(*ends))

    return F.aggregate(at, F.lit(0.0), add)


def _slack() -> Column:
    size = lambda name: F.sqrt(F.aggregate(name, F.lit(0.0), lambda s, x: s + x * x))
    return F.lit(1e-9) * (size("q_low") + size("q_high")) * (size("low") + size("high")) + 1e-6


def meet(queries: DataFrame, nodes: DataFrame, lanes: int, same_label: bool) -> DataFrame:
    """Query blocks beside nodes of their length that may hold scores in `least..most`, all of a lane in a row.

    Nodes are dealt over lanes, and every query block goes to each lane: a stated set against blocks of all rows.
    """
    of = {"ids": "q_ids", "vectors": "q_vectors", "dim": "q_dim", "label": "q_label", "low": "q_low", "high": "q_high"}
    q = queries.withColumnsRenamed(of).withColumn("q_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    c = nodes.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    label = (F.col("label") == F.col("q_label")) if same_label else (F.col("label") != F.col("q_label"))
    near = (F.col("dim") == F.col("q_dim")) & (F.col("lane") == F.col("q_lane")) & label
    if not same_label:
        boxes = ("q_low", "q_high", "low", "high")
        near = near & (_extreme(*boxes, True) + _slack() >= F.col("least")) & (_extreme(*boxes, False) - _slack() <= F.col("most"))
    # a merge join gives a query block's nodes one after another
    return q.hint("merge").join(c, near).select("dim", "q_ids", "q_vectors", "windows", "ids", "vectors")


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as 64-bit integers, exact; those beyond 64 bits stop at the ends."""
    if np.abs(q).sum(1).max(initial=0) * np.abs(c).max(initial=0) < _EXACT:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: [[int(x) for x in row] for row in m.tolist()]
    top, cols = 2**63 - 1, whole(c)
    rows = [[min(max(sum(a * b for a, b in zip(x, y, strict=True)), -top), top) for y in cols] for x in whole(q)]
    return np.array(rows, np.int64).reshape(len(q), len(c))


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that each query may have with anything in each box, a trifle wider."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) + 1e-6
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


class Best:
    """For each query and each of its windows, the k best scores within the window, ties to the smaller id."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, windows: np.ndarray, k: int):
        self.q_ids, self.q, self.k = q_ids, q, k
        self.low, self.high = windows[..., 0], windows[..., 1]
        self.scores = np.full((*self.low.shape, k), NONE, np.int64)
        self.ids = np.zeros((*self.low.shape, k), np.int64)

    def open(self, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
        """Queries for which a box with these bounds may hold something: not outside all windows, not below all k-ths."""
        need = np.maximum(self.low, self.scores[..., -1])
        inside = (greatest[:, None] >= need) & (least[:, None] <= self.high) & (self.low <= self.high)
        return np.flatnonzero(inside.any(1))

    def take(self, live: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        found = products(self.q[live], vectors)[:, None, :]
        fits = (found >= self.low[live][..., None]) & (found <= self.high[live][..., None]) & (self.q_ids[live][:, None, None] != ids)
        scores = np.concatenate([self.scores[live], np.where(fits, found, NONE)], -1)
        numbers = np.concatenate([self.ids[live], np.broadcast_to(ids, fits.shape)], -1)
        order = np.lexsort((numbers, ~scores), axis=-1)[..., : self.k]
        self.scores[live], self.ids[live] = np.take_along_axis(scores, order, -1), np.take_along_axis(numbers, order, -1)

    def search(self, nodes: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Best-first over nodes and their leaves: the box with the greatest bound comes next, hopeless ones are not opened."""
        boxes = [(v.min(0), v.max(0)) for _, v in nodes]
        least, greatest = box_bounds(self.q, np.stack([b[0] for b in boxes]), np.stack([b[1] for b in boxes]))
        heap = [(-float(greatest[:, n].max()), n, -1) for n in range(len(nodes))]
        heapq.heapify(heap)
        leaves: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        while heap:
            _, n, leaf = heapq.heappop(heap)
            ids, v = nodes[n]
            if leaf < 0:
                if not len(self.open(least[:, n], greatest[:, n])):
                    continue
                starts = np.arange(0, len(v), LEAF)
                leaves[n] = box_bounds(self.q, np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts))
                for k in range(len(starts)):
                    heapq.heappush(heap, (-float(leaves[n][1][:, k].max()), n, k))
                continue
            live = self.open(leaves[n][0][:, leaf], leaves[n][1][:, leaf])
            if len(live):
                part = slice(leaf * LEAF, (leaf + 1) * LEAF)
                self.take(live, ids[part], v[part])

    def rows(self) -> pa.RecordBatch:
        query, slot, place = np.nonzero(self.scores > NONE)
        data = [self.q_ids[query], slot.astype("i4"), self.ids[query, slot, place], self.scores[query, slot, place]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in data], names=["query_id", "slot", "vec_id", "score"])


FOUND = "query_id bigint, slot int, vec_id bigint, score bigint"


def searcher(k: int, at_once: int = 16):
    """Function for `mapInArrow` over what `meet` gives; holds one query block and `at_once` nodes at a time."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key, nodes = None, None, []
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for row in range(batch.num_rows):
                dim, own = columns["dim"][row].as_py(), (columns["q_ids"][row].as_py(), columns["windows"][row].as_py())
                if own != key or len(nodes) >= at_once:
                    if nodes:
                        best.search(nodes)
                        nodes = []
                    if own != key:
                        if best is not None:
                            yield best.rows()
                        key, q_ids = own, np.frombuffer(own[0], "<i8")
                        windows = np.frombuffer(own[1], "<i8").reshape(len(q_ids), -1, 2)
                        best = Best(q_ids, np.frombuffer(columns["q_vectors"][row].as_py(), "<f8").reshape(-1, dim), windows, k)
                vectors = np.frombuffer(columns["vectors"][row].as_py(), "<f8").reshape(-1, dim)
                nodes.append((np.frombuffer(columns["ids"][row].as_py(), "<i8"), vectors))
        if nodes:
            best.search(nodes)
        if best is not None:
            yield best.rows()

    return search
