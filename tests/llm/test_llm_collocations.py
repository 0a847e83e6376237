"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from eventmill.llm import word_codes
from eventmill.llm.collocations import top_collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def _plain(rows, top=2000, least=30, percent=80):
    counts, words = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        of = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            found = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(found)
            for size in range(1, 5):
                of.update(tuple(found[i : i + size]) for i in range(len(found) - size + 1))
    out = []
    for lang, of in counts.items():
        known = {p: a for p, a in of.items() if a >= least and len(p) > 1}
        gone = set()
        for longer, f in known.items():
            for size in range(2, len(longer)):
                for i in range(len(longer) - size + 1):
                    if 100 * f >= percent * known[longer[i : i + size]]:
                        gone.add(longer[i : i + size])
        scored = []
        for p, a in known.items():
            score, k = min((2000000 * a // (of[p[:k]] + of[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]], p not in gone))
        best = sorted(s for s in scored if s[-1])[:top]
        out += [(lang, i, s[2].decode(), -s[1], s[3], s[4], words[lang], -s[0]) for i, s in enumerate(best, 1)]
    return sorted(out)


def _run(spark, rows, schema="text string, lang string", **options):
    found = top_collocations(spark.createDataFrame(rows, schema), **options)
    assert found.columns == COLUMNS
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(25)] + ["É", "THE", "the", "z" * 60, "z" * 59 + "y"]
    fixed = ["one two three four", "one two three", "New York", "a b c d e f", "x y", "x y z"]
    rows = []
    for _ in range(150):
        parts = [rng.choice(fixed) if rng.random() < 0.35 else rng.choice(vocabulary) for _ in range(rng.randrange(1, 80))]
        rows.append((rng.choice([" ", "  ", "\t"]).join(p + rng.choice(["", "", "", "", ",", ".", "\n", "\x0b"]) for p in parts), rng.choice(["en", "en", "de", None])))
    return rows


def test_equals_plain_counting(spark, prose):
    assert _run(spark, prose) == _plain(prose) != []


@pytest.mark.parametrize("top, percent", [(1, 80), (3, 80), (7, 50), (7, 100)])
def test_frontier_is_lowered_until_the_top_is_settled(spark, prose, top, percent):
    assert _run(spark, prose, top=top, least=5, percent=percent) == _plain(prose, top, 5, percent)


def test_empty_unusual_and_repeated_rows(spark):
    assert _run(spark, []) == []
    rows = [(None, "en"), ("", "en"), (" \n\t.", "en"), ("one", None)] + [("Good Day to all", "en")] * 30 + [("good day, to all " * 20000, None)]
    assert _run(spark, rows) == _plain(rows) != []
    wide = "text string, lang string, w1 int, code int, a int, l int, bound int, phrase string"
    assert _run(spark, [(*r, 1, 1, 1, 1, 1, "p") for r in rows], wide) == _plain(rows)


def test_pieces_lose_and_double_nothing(monkeypatch):
    monkeypatch.setattr(word_codes, "PIECE", 7)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é.\n\tZ") for _ in range(rng.randrange(0, 60))) for _ in range(50)] + ["q" * 100]
    found, segments = [], []
    for codes, segment, old, data, starts, stops in word_codes.pieces(pa.array(texts), 0, 3):
        assert old <= 3 and len(codes) == len(segment) == old + len(starts)
        found += [data[a:b].tobytes().decode() for a, b in zip(starts, stops, strict=True)]
        segments += segment[old:].tolist()
    expected, same = [], []
    for text in texts:
        for piece in re.split(r"[.\n]", text.replace("Z", "z")):
            words = re.findall(r"[^ \t]+", piece)
            expected += words
            same += [False, *[True] * (len(words) - 1)][: len(words)]
    assert found == expected
    assert [False, *(np.diff(segments) == 0).tolist()] == same


def test_phrases_with_equal_keys_stay_apart():
    keys, words = np.zeros(6, np.uint64), np.array([1, 2, 1, 2, 2, 1], np.uint64)
    at, n = word_codes.counted(keys, [words])
    totals = Counter()
    for i, times in zip(at.tolist(), n.tolist(), strict=True):
        totals[int(words[i])] += times
    assert totals == {1: 3, 2: 3}
