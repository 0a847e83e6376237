"""Shards cut from the order of a Hilbert curve through several metadata dimensions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.functions.once import let
from eventmill.llm.common import offsets, ordered, ranked, saved, text_of

SHARDS = 24
DIMENSIONS = ("source", "lang", "n_chars", "doc_id")
BITS = 8


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """Position of a cell (whole numbers below 2**bits) on the Hilbert curve through all cells of that many dimensions.

    From the highest bit down, one bit of every dimension gives a corner of the current cube. Corners are walked in Gray
    code order, seen from the cube's entry corner and along its direction; both change with the corner taken.
    """
    n, last = len(cells), 2 ** len(cells) - 1
    gray = [w ^ (w >> 1) for w in range(last + 1)]
    place = [gray.index(g) for g in range(last + 1)]  # of a corner in Gray code order
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(last + 1)]
    ones = [(~w & (w + 1)).bit_length() - 1 for w in range(last + 2)]  # ones at the end of the binary number
    turn = [0 if w == 0 else ones[w - 1 if w % 2 == 0 else w] % n for w in range(last + 1)]
    places, entries, turns = (F.array(*[F.lit(x) for x in table]) for table in (place, entry, turn))

    def rotated(x: Column, by: Column, left: bool) -> Column:
        """x of n bits, rotated; `by` from 1 to n."""
        low = F.call_function("shiftleft", x, by if left else F.lit(n) - by)
        high = F.call_function("shiftright", x, F.lit(n) - by if left else by)
        return low.bitwiseOR(high).bitwiseAND(F.lit(last))

    def step(state: Column, i: Column) -> Column:
        corner = F.lit(0)
        for k, cell in enumerate(cells):
            bit = F.call_function("shiftright", cell, i).bitwiseAND(F.lit(1))
            corner = corner.bitwiseOR(F.shiftleft(bit, k))
        by = state["d"] + 1
        at = F.get(places, rotated(corner.bitwiseXOR(state["e"]), by, left=False))
        return let(
            at,
            lambda w: F.struct(
                F.shiftleft(state["h"], n).bitwiseOR(w.cast("bigint")).alias("h"),
                state["e"].bitwiseXOR(rotated(F.get(entries, w), by, left=True)).alias("e"),
                ((state["d"] + F.get(turns, w) + 1) % n).alias("d"),
            ),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["h"]


def quantised(df: DataFrame, dimensions: Sequence[str], bits: int) -> list[Column]:
    """A cell number below 2**bits per dimension that never falls as the value grows; NULL is in cell 0.

    Numbers are spread over their range, by logarithm where none is negative. Of texts, the four bytes after what the
    least and the greatest have in common count. One aggregate finds all ranges.
    """
    kinds = dict(df.dtypes)
    ends = df.agg(*[f(F.col(f"`{d}`")).alias(f"{d}:{f.__name__}") for d in dimensions for f in (F.min, F.max)]).first()
    cells, top = [], 2**bits - 1
    for d in dimensions:
        least, most = ends[f"{d}:min"], ends[f"{d}:max"]
        if least is None:
            cells.append(F.lit(0))
            continue
        if kinds[d] == "string":
            a, b = least.encode(), most.encode()
            common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

            def number(text: bytes, common: int = common) -> int:
                return int.from_bytes(text[common : common + 4].ljust(4, b"\0"), "big")

            bytes_ = F.substring(F.hex(F.encode(F.col(f"`{d}`"), "UTF-8")), 2 * common + 1, 8)
            value, low, high = F.conv(F.rpad(bytes_, 8, "0"), 16, 10).cast("double"), number(a), number(b)
        else:
            value, low, high = F.col(f"`{d}`").cast("double"), float(least), float(most)
            if low >= 0 and d != "doc_id":
                value, low, high = F.log1p(value), math.log1p(low), math.log1p(high)
        scaled = F.floor((value - F.lit(float(low))) / F.lit(float(high - low) or 1.0) * F.lit(float(2**bits)))
        cells.append(F.coalesce(F.least(F.greatest(scaled, F.lit(0)), F.lit(top)), F.lit(0)).cast("int"))
    return cells


def shard_by_curve(
    docs: DataFrame, shards: int = SHARDS, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS, texts: bool = False
) -> DataFrame:
    """`doc_id, size, text_crc32, curve, shard, slot` (with `texts`: and all other columns): runs of the Hilbert order.

    Rows stand by their place on the curve, then by checksum and doc_id, and are cut into `shards` runs whose row counts
    differ by one at most, so that each shard covers a small box of the dimensions. `slot` numbers the rows of a shard
    from 0. `size` is the length of the text in UTF-8 plus 8; NULL texts count as empty (checksum 0), NULLs in a dimension
    as its least cell. Repeated rows get slots of their own; equal texts within a cell stand together. An empty table
    gives an empty table. Of the extra columns, those with the names of the result are replaced.
    """
    made = ("size", "text_crc32", "curve", "shard", "slot")
    text = text_of(docs)
    used = list(dict.fromkeys(["doc_id", *dimensions]))
    keep = [c for c in docs.columns if texts and c.lower() not in made or c in used]
    narrow = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    if not texts:
        narrow = saved(narrow, "shard-metadata")
    cells = quantised(narrow, dimensions, bits)
    placed = narrow.withColumns({f"_cell{i}": c for i, c in enumerate(cells)})
    names = [F.col(f"_cell{i}") for i in range(len(cells))]
    placed = placed.select(*[F.col(f"`{c}`") for c in narrow.columns], hilbert_index(names, bits).alias("curve"))
    rows = ordered(placed, [F.col("curve"), F.col("text_crc32"), F.col("doc_id")], "shard-order")
    total = rows.count()
    cut = ranked(rows, offsets(rows)).withColumn("shard", F.expr(f"cast(rank * {shards}L div {max(total, 1)}L as int)"))
    start = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    out = [c for c in keep if c != "doc_id"] if texts else []
    return cut.select(
        "doc_id", *[F.col(f"`{c}`") for c in out], "size", "text_crc32", "curve", "shard", (F.col("rank") - start).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write whole rows into one folder per shard, in slot order; the shuffle splits no shard over tasks needlessly."""
    placed = shard_by_curve(docs, texts=True, **options)
    placed.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
