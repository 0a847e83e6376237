"""Names as 64-bit numbers, found in whole Arrow batches of texts, and filters of bounded size over such numbers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a name that are looked for at every place of a text; the whole name is looked for only where these are found.
HEAD = 4
#: Bits of a filter for each name, and the most of all: 16 MB. More names than fit make it pass more, never less.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Bytes of text taken at a time, and a name's length at most on top.
AT_ONCE = 1 << 20

_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        each = np.full(n, base, np.uint64)
        each[:1] = 1
        out.append(np.multiply.accumulate(each))
    return out[0], out[1]


class Stretches:
    """Numbers of any stretches of some bytes, by one running sum."""

    def __init__(self, data: np.ndarray):
        # a power of two, so that few lengths are kept
        self.up, self.down = _powers(1 << max(0, len(data)).bit_length())
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def numbers(self, starts: np.ndarray, size: int) -> np.ndarray:
        return _mixed((self.sums[starts + size] - self.sums[starts]) * self.down[starts] + np.uint64(size))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), ends


@F.arrow_udf(T.StructType([T.StructField("head", T.LongType()), T.StructField("whole", T.LongType())]))
def name_numbers(names: pa.Array) -> pa.Array:
    """The numbers of the first bytes of each name, and of all."""
    data, ends = _buffers(names)
    rows = []
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        of, first = Stretches(data[start:end]), np.zeros(1, np.int64)
        rows.append([int(of.numbers(first, size).view(np.int64)[0]) for size in (min(HEAD, end - start), end - start)])
    heads, wholes = zip(*rows, strict=True) if rows else ((), ())
    return pa.StructArray.from_arrays([pa.array(heads, pa.int64()), pa.array(wholes, pa.int64())], names=["head", "whole"])


class Filter:
    """Bits that tell which numbers may be in a set; those that are in it always may."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def may_hold(self, numbers: np.ndarray) -> np.ndarray:
        found = np.ones(len(numbers), bool)
        for place in (numbers & self.mask, (numbers >> np.uint64(32)) & self.mask):
            found &= ((self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
        return found


def filter_words(numbers: DataFrame, columns: list[str], count: int) -> list[np.ndarray]:
    """Bits of the numbers of each column: an aggregate by 64-bit word, so what comes to the driver has the filters' bound."""
    bits = 1 << 16
    while bits < min(MOST_BITS, BITS_EACH * count):
        bits *= 2
    place = lambda i, number: F.struct(F.lit(i).alias("of"), number.bitwiseAND(bits - 1).alias("place"))
    places = F.array(*[place(i, n) for i, c in enumerate(columns) for n in (F.col(c), F.shiftrightunsigned(c, 32))])
    words = numbers.select(F.inline(places)).groupBy("of", F.shiftright("place", 6).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros((len(columns), bits >> 6), np.uint64)
    out[found.column("of").to_numpy(), found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return list(out)


def possible_names(session: SparkSession, text: Column, heads: np.ndarray, wholes: np.ndarray, sizes: list[int]) -> Column:
    """Of each text, the numbers of stretches that may be names of these lengths (bytes, ascending), each once."""
    shared = session.sparkContext.broadcast((heads, wholes))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def possible(texts: pa.Array) -> pa.Array:
        head, whole = (Filter(words) for words in shared.value)
        data, ends = _buffers(texts)
        last, at, numbers, lines = int(ends[-1]), int(ends[0]), [], []
        while at < last:
            to = min(at + AT_ONCE, last)
            part = data[at : min(to + sizes[-1] - 1, last)]
            of, begun = Stretches(part), {}
            for size in sizes:
                short = min(size, HEAD)
                if short not in begun:
                    starts = np.arange(min(to - at, len(part) - short + 1))
                    starts = starts[head.may_hold(of.numbers(starts, short))] if len(starts) else starts
                    line = np.searchsorted(ends, starts + at, "right") - 1
                    begun[short] = starts, line, ends[line + 1] - at
                starts, line, end = begun[short]
                fits = np.flatnonzero(starts + size <= end)
                number = of.numbers(starts[fits], size)
                hit = whole.may_hold(number)
                numbers.append(number[hit])
                lines.append(line[fits[hit]])
            at = to
        number, line = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((numbers, np.uint64), (lines, np.int64)))
        order = np.lexsort((number, line))
        number, line = number[order], line[order]
        new = np.ones(len(line), bool)
        new[1:] = (number[1:] != number[:-1]) | (line[1:] != line[:-1])
        counts = np.bincount(line[new], minlength=len(texts))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype("i4")), pa.array(number[new].view(np.int64)))

    # looked at twice it would be computed twice
    return possible.asNondeterministic()(text)
