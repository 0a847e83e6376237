"""Words of whole Arrow batches as 64-bit numbers, in bounded pieces, and counts of the phrases they form."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text taken at a time; only a single longer word is taken whole.
PIECE = 1 << 21
#: Words up to so many bytes get a polynomial of their bytes, longer ones a digest.
SHORT = 48
_BITS = 26

_BETWEEN = np.zeros(256, bool)
_BETWEEN[[0x20, 0x09, *b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PAUSE = _BETWEEN.copy()
_PAUSE[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number for each number, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digest(data: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


def phrase_keys(codes: list[np.ndarray], salt: int) -> np.ndarray:
    """A number for each phrase, given the numbers of its first words, second words and so on."""
    total = np.full(len(codes[0]), salt, np.uint64)
    for code in codes:
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + code)
    return total


def word_codes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int) -> np.ndarray:
    """A number per word of the lower-cased bytes."""
    sizes = stops - starts
    base = np.uint64(digest(b"base", seed) | 1)
    codes = np.zeros(len(starts), np.uint64)
    # byte by byte of all words that are that long: words are short, and the longer ones are few
    live, at = np.arange(len(starts)), 0
    while len(live):
        codes[live] = codes[live] * base + data[starts[live] + at].astype(np.uint64) + np.uint64(1)
        at += 1
        live = live[(sizes[live] > at) & (sizes[live] <= SHORT)] if at == 1 else live[sizes[live] > at]
    codes = mixed(codes ^ mixed(sizes.astype(np.uint64)))
    for i in np.flatnonzero(sizes > SHORT).tolist():
        codes[i] = digest(data[starts[i] : stops[i]].tobytes(), seed)
    return codes


class Filter:
    """Fixed bits that tell which numbers may be in a set; never wrong about those that are."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(keys: np.ndarray) -> list[np.ndarray]:
        return [(keys >> np.uint64(shift)) & np.uint64((1 << _BITS) - 1) for shift in (0, 32)]

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for place in self.places(keys):
            found &= ((self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
        return found


def _cut(between: np.ndarray, at: int) -> int:
    """The first place from `at + PIECE` where no word is cut."""
    to, look = at + PIECE, 1 << 12
    while to < len(between):
        found = np.flatnonzero(between[to : to + look])
        if len(found):
            return to + int(found[0])
        to, look = to + look, look * 2
    return len(between)


def pieces(texts: pa.Array, seed: int, carry: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """`codes, segments, old, data, starts, stops` for bounded pieces of the texts that follow each other.

    Words of one segment follow each other without a pause. The first `old` words were in the piece before, at most
    `carry`; `starts` and `stops` in the lower-cased bytes `data` are those of the others.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    edges = np.unique(ends - ends[0])
    between = _BETWEEN[whole]
    # a text may begin with a word; the place before it is none, so cuts look at both
    may_cut = between.copy()
    may_cut[edges[edges < len(whole)]] = True
    codes, segments, passed, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
    while at < len(whole):
        to = _cut(may_cut, at)
        data, gap = _LOWER[whole[at:to]], between[at:to]
        first = np.zeros(to - at, bool)
        inside = edges[(edges >= at) & (edges < to)] - at
        first[inside] = True
        marks = np.cumsum(_PAUSE[data] | first) + passed
        word = ~gap
        begins = word.copy()
        begins[1:] &= gap[:-1] | first[1:]
        ends_ = word.copy()
        ends_[:-1] &= gap[1:] | first[1:]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends_) + 1
        old = min(carry, len(codes))
        codes = np.concatenate([codes[len(codes) - old :], word_codes(data, starts, stops, seed)])
        segments = np.concatenate([segments[len(segments) - old :], marks[starts]])
        yield codes, segments, old, data, starts, stops
        passed, at = int(marks[-1]), to


def counted(keys: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the different phrases and how often each occurs; phrases whose keys are equal by chance stay apart."""
    order = np.argsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = False
    for part in parts:
        own = part[order]
        new[1:] |= own[1:] != own[:-1]
    starts = np.flatnonzero(new)
    return order[starts], np.diff(np.append(starts, len(order)))
