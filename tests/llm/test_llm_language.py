"""The byte network against plain versions, and its accuracy on documents it has not seen."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventmill.llm import byte_network as bn
from eventmill.llm.language_id import held_out, predict_language
from eventmill.plans.workload import table


def _plain(net, symbols):
    """Class scores of one window, filter by filter."""
    features = []
    for width, weights, offset in zip(bn.WIDTHS, net.filters, net.offsets, strict=True):
        sums = [np.concatenate([net.table[s] for s in symbols[t : t + width]]) @ weights for t in range(len(symbols) - width + 1)]
        features.append(np.maximum(np.max(sums, 0) + offset, 0))
    return bn.log_softmax(np.concatenate(features) @ net.out + net.out_offset)


def test_slopes_equal_differences():
    rng = np.random.default_rng(1)
    windows, labels, net = rng.integers(0, 257, (7, bn.WINDOW)), rng.integers(0, 3, 7), bn.new_network(3)
    _, slopes = bn.loss_and_slopes(net, windows, labels)
    for p, slope in zip(net.parameters(), slopes, strict=True):
        for at in rng.choice(p.size, 6):
            kept, small = p.flat[at], 1e-6
            p.flat[at] = kept + small
            up, _ = bn.loss_and_slopes(net, windows, labels)
            p.flat[at] = kept - small
            down, _ = bn.loss_and_slopes(net, windows, labels)
            p.flat[at] = kept
            assert (up - down) / (2 * small) == pytest.approx(slope.flat[at], abs=1e-5)


def test_tables_equal_plain_convolution(monkeypatch):
    monkeypatch.setattr(bn, "_AT_ONCE", 3)
    net, rng = bn.new_network(4, seed=2), np.random.default_rng(2)
    texts = [bytes(rng.integers(32, 250, n).tolist()) for n in (0, 1, 5, 127, 128, 129, 700)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    found = bn.Reader(net).read(data, ends)
    for text, logs in zip(texts, found, strict=True):
        expected = np.zeros(4)
        for at in range(0, len(text), bn.WINDOW):
            part = [b + 32 if 65 <= b <= 90 else b for b in text[at : at + bn.WINDOW]]
            expected += len(part) * _plain(net, part + [bn.PAD] * (bn.WINDOW - len(part)))
        assert logs == pytest.approx(expected / max(1, len(text)), abs=1e-4)


def test_unseen_documents_are_told_apart(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").withColumn("held_out", held_out(F.col("doc_id")))
    found = predict_language(docs, ~F.col("held_out")).select("doc_id", "held_out", "lang", "lang_pred", "score").collect()
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    unseen = [r["lang"] == r["lang_pred"] for r in found if r["held_out"]]
    assert sum(unseen) / len(unseen) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_unusual_rows_and_what_is_not_an_input(spark):
    de, en = "der Weg über die Brücke und zurück ", "the way over the bridge and back "
    rows = [(i, (de if i % 2 else en) * (1 + i % 5), "de" if i % 2 else "en", "x", 1) for i in range(80)]
    odd = [(None, en, None, None, 2), (200, None, "de", "x", 2), (201, "", "de", "x", 2), (202, "12 34 !?", "en", "x", 2),
           (203, de * 20000, "en", "y", 2), (204, en, "de", "x", 2), (204, en, "fr", "z", 2), (205, en.upper(), None, "x", 2)]
    schema = "doc_id bigint, text string, lang string, lang_pred string, readable int"
    found = predict_language(spark.createDataFrame(rows + odd, schema), F.col("readable") == 1)
    assert found.columns == ["doc_id", "lang", "readable", "lang_pred", "score"]
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in found.where("readable = 2").collect()), key=str)
    assert [(i, lang) for i, lang, _ in got] == [
        (200, "und"), (201, "und"), (202, "und"), (203, "de"), (204, "en"), (204, "en"), (205, "en"), (None, "en")
    ]
    assert [s for _, lang, s in got if lang == "und"] == [0.0] * 3 and got[4][2] == got[5][2] > 0.5
    assert all((r["lang"] == r["lang_pred"]) for r in found.where("readable = 1").collect())


def test_nothing_to_learn_and_no_rows(spark):
    schema = "doc_id bigint, text string, lang string"
    empty = predict_language(spark.createDataFrame([], schema), F.lit(True))
    assert empty.columns == ["doc_id", "lang", "lang_pred", "score"] and empty.collect() == []
    rows = spark.createDataFrame([(1, "some text", None), (2, "more", "en")], schema)
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in predict_language(rows, F.lit(False)).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in predict_language(rows, F.lit(True)).collect()} == {(1, "en", 1.0), (2, "en", 1.0)}


def test_same_input_same_network():
    rng = np.random.default_rng(4)
    windows, labels = rng.integers(0, 257, (40, bn.WINDOW)), rng.integers(0, 2, 40)
    one, two = (bn.train(windows, labels, 2, steps=3) for _ in range(2))
    assert all((a == b).all() for a, b in zip(one.parameters(), two.parameters(), strict=True))
