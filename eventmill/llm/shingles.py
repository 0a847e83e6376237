"""Word shingles as 64-bit numbers, for whole Arrow batches of texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes of text hashed at a time; a longer text is hashed by itself.
AT_ONCE = 100_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number for each number."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return _usual_powers(base)[:n] if n <= AT_ONCE else _all_powers(base, n)


@lru_cache
def _usual_powers(base: int) -> np.ndarray:
    return _all_powers(base, AT_ONCE)


def _all_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _factors(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number per word, and where the words of each text end, for texts that end at `ends` in the bytes `data`.

    Words are runs of anything but ASCII white space; A to Z count as a to z. The number of a word is a polynomial of its
    bytes, taken from one running sum.
    """
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = True
    edge[ends] = True
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    stops = np.flatnonzero(word & (~after | edge[1:])) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)))])
    hashes = (sums[stops] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    hashes = _mixed(hashes ^ _mixed((stops - starts).astype(np.uint64)))
    return hashes, np.searchsorted(starts, ends)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text, its distinct shingles of `width` words as sorted numbers.

    A text of fewer words has one shingle, all its words; a text without words, or NULL, has none.
    """
    factors = _factors(width)
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, "right")) - 1)
        to = min(to, len(texts))
        data, ends = whole[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        words, stops = word_hashes(data, ends)
        total = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            total += words[k : k + len(total)] * factors[k]
        total = _mixed(total)
        start = 0
        for stop in stops.tolist():
            if stop - start >= width:
                yield np.unique(total[start : stop - width + 1])
            elif stop > start:
                short = np.uint64((words[start:stop] * factors[: stop - start]).sum() + np.uint64(stop - start))
                yield _mixed(np.array([short]))
            else:
                yield np.zeros(0, np.uint64)
            start = stop
        at = to


def fingerprint(shingles: np.ndarray) -> bytes:
    """The same for equal sets; 128 bits."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
