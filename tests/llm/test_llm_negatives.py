"""Hard negatives against a plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventmill.llm import str_tree
from eventmill.llm.hard_negatives import mine_hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def _plain(rows, anchor, positives=5, negatives=10, low=30, high=90):
    usable = [
        (i, tuple(int(x * 256 // 1) for x in v), label)
        for i, v, label in rows
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    anchors = {}
    for i, v, label in usable:
        if anchor(i):
            anchors[i] = min(anchors.get(i, (str(label), v)), (str(label), v))
    out = []
    for a, (label, v) in anchors.items():
        def best(keep, k):
            found = [(sum(x * y for x, y in zip(v, w, strict=True)), i) for i, w, other in usable if i != a and len(w) == len(v) and keep(str(other))]
            return sorted(found, key=lambda x: (-x[0], x[1]))[:k] if k else found

        for p, positive in best(lambda other: other == label, positives):
            fits = [(s, i) for s, i in best(lambda other: other != label, 0) if low * p <= 100 * s <= high * p]
            fits = sorted(fits, key=lambda x: (-x[0], x[1]))[:negatives]
            out += [(a, positive, rank, i, p, s) for rank, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def _run(spark, rows, schema=SCHEMA, **options):
    found = mine_hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 10 == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def test_equals_a_plain_search(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(str_tree, "NODE", 40)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(400):
        label = rng.choice([0, 0, 0, 1, 2, 3])
        # few different values, so that scores tie
        rows.append((i, [round(4 * (c + rng.gauss(0, 0.7))) / 4 for c in centre[label]], label))
    rows += [(1000 + i, [0.5] * 6, 1) for i in range(150)]  # one very frequent vector
    rng.shuffle(rows)
    assert _run(spark, rows) == _plain(rows, lambda i: i % 10 == 0)
    assert _run(spark, rows, positives=2, negatives=3, low=10, high=99) == _plain(rows, lambda i: i % 10 == 0, 2, 3, 10, 99)


def test_unusable_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (2, [0.5, 0.5], 2),
        (3, None, 2), (4, [], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (8, [0.5, 0.5], None),
        (None, [0.5, 0.5], 2), (9, [0.5], 2), (10, [1.0], 2), (11, [1e30, 1.0], 1), (12, [1e12, 3.0], 2), (20, [1e25, 1.0], 2),
        (30, [-1.0, 0.0], 1),
    ]
    found = _run(spark, rows)
    small = [r for r in rows if r[0] not in (11, 12, 20)]
    assert _run(spark, small) == _plain(small, lambda i: i % 10 == 0) != []
    # scores beyond 64 bits stop at the ends
    assert all(abs(r[4]) < 2**63 and abs(r[5]) < 2**63 for r in found)


def test_exact_beyond_double_precision(spark):
    q = np.array([[2.0**40 + 1, 3.0], [-(2.0**40), 1.0]])
    c = np.array([[2.0**20, 1.0], [2.0**20 + 1, -1.0], [2.0**60, 0.0]])
    top = 2**63 - 1
    expected = [[min(max(sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), -top), top) for y in c] for x in q]
    assert str_tree.products(q, c).tolist() == expected


def test_empty_table_and_clashing_columns(spark):
    assert _run(spark, []) == []
    rows = [(i, [float(i % 7), float(i % 5)], i % 3) for i in range(60)]
    plain = _plain(rows, lambda i: i % 10 == 0)
    wide = "vec_id bigint, embedding array<double>, label int, v int, score int, low int, high int, ids int, dim int, slot int, rank int"
    assert _run(spark, [(*r, *[1] * 8) for r in rows], wide) == plain


@pytest.mark.parametrize("dims", [1, 2, 5])
def test_box_bounds_hold_and_order_is_a_permutation(dims):
    rng = np.random.default_rng(dims)
    v, q = np.floor(rng.normal(0, 100, (777, dims))), np.floor(rng.normal(0, 100, (9, dims)))
    order = str_tree.str_order(v, 0)
    assert sorted(order.tolist()) == list(range(777))
    starts = np.arange(0, 777, str_tree.LEAF)
    low, high = str_tree.box_bounds(q, np.minimum.reduceat(v[order], starts), np.maximum.reduceat(v[order], starts))
    scores = q @ v[order].T
    leaf = np.arange(777) // str_tree.LEAF
    assert (scores <= high[:, leaf]).all() and (scores >= low[:, leaf]).all()
