"""Joins, searches, mixing, shards and the pipeline against plain versions."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventmill.llm import components, ngram_join
from eventmill.llm.bpe import encode_texts
from eventmill.llm.common import saved
from eventmill.llm.components import connected_components
from eventmill.llm.mixing import mix_sources, mixed_rows
from eventmill.llm.neighbours import nearest_neighbours
from eventmill.llm.ngram_join import link_components
from eventmill.llm.quality import with_features
from eventmill.llm.sharding import hilbert_index, shard_by_curve, write_shards
from eventmill.llm.shingles import shingle_sets
from eventmill.llm.topk import top_products
from eventmill.session import bound_batches


def _components(rows, width, percent):
    sets, parent = defaultdict(list), {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        own = {tuple(words)} if 0 < len(words) < width else {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
        sets[i].append(own)
    all_sets = [(i, s) for i, own in sets.items() for s in own if i is not None and s]
    for k, (i, a) in enumerate(all_sets):
        for j, b in all_sets[:k]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def _near_copies(rng, documents=40, copies=12):
    words = [f"w{k}" for k in range(60)] + ["THE", "of", "É"]
    rows, number = [], 0
    shared = " ".join(rng.choice(words) for _ in range(60))
    for _ in range(documents):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 60, 150]))]
        if rng.random() < 0.3:
            base += shared.split()
        for _ in range(rng.randrange(1, copies)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 15)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((number, rng.choice([" ", "\n", "  \t"]).join(own)))
            number += rng.randrange(1, 4)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "width", "percent", "rounds"), [(1, 4, 85, 3), (2, 5, 80, 1), (3, 2, 70, 1)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, width, percent, rounds):
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rng = random.Random(seed)
    rows = _near_copies(rng) + [(10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "x " * 30_000), (10_005, "x " * 30_001), (None, "w1 w2 w3 w4 w5")]
    rows += [(10_006, "same row twice of five words"), (10_006, "same row twice of five words"), (10_007, "a b c d"), (10_007, "other words in here now")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("x")).withColumn("token", F.lit(1))
    found = link_components(df.repartition(5), width, percent).collect()
    expected = _components(rows, width, percent)
    assert len(found) == len(rows)
    for row in found:
        assert row["component_id"] == (expected[row["doc_id"]] if row["doc_id"] is not None else None)
    assert {r["doc_id"]: r["n_shingles"] for r in found}[10_002] == 0


def test_sets_that_share_a_number_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ID_BITS", 14)  # a few of some hundred sets meet
    rng = random.Random(11)
    rows = _near_copies(rng, documents=60, copies=8)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = ngram_join._own_sets(df, 4).where("n > 0").groupBy("print").agg(F.first("low").alias("low"), F.first("low2").alias("low2")).cache()
    numbered, moved = ngram_join._numbered(sets)
    assert moved and sets.select("low").distinct().count() < sets.count() == numbered.select("low").distinct().count()
    expected = _components(rows, 4, 85)
    assert {r["doc_id"]: r["component_id"] for r in link_components(df, 4, 85).collect()} == expected


def test_passages_of_many_documents_count_as_frequent_in_any_number_of_parts(spark, monkeypatch):
    rng = random.Random(12)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 200))) + " " + passage) for i in range(60)]
    made = {}
    keep = ngram_join.saved
    monkeypatch.setattr(ngram_join, "saved", lambda df, label: (out := keep(df, label), made.update({label: out.count()}))[0])
    for parts in (1, 30):
        found = link_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts), 5, 80).collect()
        assert all(r["doc_id"] == r["component_id"] for r in found)
        assert made["index"] == 0  # the places at the front are left to the tokens of one document


def test_near_copies_of_one_text_are_not_compared_in_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(400):
        own = list(base)
        own[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(own)))
    made = Counter()
    keep = ngram_join.saved
    monkeypatch.setattr(ngram_join, "saved", lambda df, label: (out := keep(df, label), made.update({label: out.count()}))[0])
    found = link_components(spark.createDataFrame(rows, "doc_id int, text string"), 4, 85)
    assert {r["component_id"] for r in found.collect()} == {0}
    assert sum(n for label, n in made.items() if label.endswith("pairs") or label == "decided") < 5 * len(rows)


def test_copies_that_lie_apart_from_each_other_are_told_by_sketch(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(300):  # two words changed in each, and no copy without changes
        own = list(base)
        for at in rng.sample(range(0, 150, 10), 2):
            own[at + rng.randrange(3)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    made = Counter()
    keep = ngram_join.saved
    monkeypatch.setattr(ngram_join, "saved", lambda df, label: (out := keep(df, label), made.update({label: out.count()}))[0])
    found = link_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == _components(rows, 4, 85)
    assert sum(n for label, n in made.items() if label.endswith("pairs") or label == "decided") < 40 * len(rows)


@pytest.mark.parametrize("sent", [0, 2_000_000])
def test_rounds_of_the_join_deal_their_rows_out_a_few_times_only(spark, monkeypatch, sent):
    for name, value in (("BLOCK", 3), ("LANES", 2), ("OPEN", 0), ("SENT_IDS", sent)):
        monkeypatch.setattr(ngram_join, name, value, raising=False)
    dealt, keep = defaultdict(list), saved

    def counting(df, label):
        dealt[label].append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return keep(df, label)

    monkeypatch.setattr(ngram_join, "saved", counting)
    monkeypatch.setattr(components, "saved", counting)
    rows = _near_copies(random.Random(13)) + [(20_000 + i, f"one two three four five six seven eight nine ten x{i}") for i in range(40)]
    found = link_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == _components(rows, 4, 85)
    assert max(dealt["left0"] + dealt["left1"]) <= 4  # 13 before


def test_labels_of_a_star_are_done_after_one_round(spark, monkeypatch):
    made, keep = [], saved
    monkeypatch.setattr(components, "saved", lambda df, label: (made.append(label), keep(df, label))[1])
    links = spark.createDataFrame([(50, i) for i in range(50)] + [(50, 50), (None, 3), (7, None)], "a bigint, b bigint")
    assert {(r["id"], r["component"]) for r in connected_components(links).collect()} == {(i, 0) for i in range(51)}
    assert made == ["labels", "labels"]


@pytest.mark.parametrize(
    "operator",
    [
        lambda docs: link_components(docs),
        lambda docs: with_features(docs, "f"),
        lambda docs: encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    ],
    ids=["join", "features", "encoding"],
)
def test_whole_texts_go_to_python_a_few_mb_at_a_time(spark, operator):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    own = spark.newSession()  # has settings of its own
    operator(own.createDataFrame([(1, "a b c d e f"), (2, "")], "doc_id bigint, text string"))
    texts = own.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    found = [r["bytes"] for r in texts.mapInArrow(sizes, "bytes bigint").collect()]
    assert sum(found) >= 24_000_000 and max(found) < 6_000_000
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    operator(own.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string"))
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"


def test_batches_of_whole_texts_are_a_mb_at_most(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    own = spark.newSession()
    bound_batches(own)
    texts = own.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    found = [r["bytes"] for r in texts.mapInArrow(sizes, "bytes bigint").collect()]
    assert sum(found) >= 12_000_000 and max(found) < 1_200_000


def _direct_bytes(spark):
    jvm = spark.sparkContext._jvm.java.lang
    pools = jvm.management.ManagementFactory.getPlatformMXBeans(jvm.Class.forName("java.lang.management.BufferPoolMXBean"))
    return sum(p.getMemoryUsed() for p in pools if p.getName() == "direct")


def _texts(spark, rows, blocks):
    """Texts of `blocks` times 128 letters that do not pack well, in two parts."""
    text = F.expr(f"concat_ws('', transform(sequence(1, {blocks}), k -> sha2(concat(id, ' ', k), 512)))")
    return spark.range(0, rows, 1, 2).select(text.alias("text"))


def test_reading_long_texts_keeps_no_columns_outside_the_heap(spark):
    own, before = spark.newSession(), _direct_bytes(spark)
    texts = saved(_texts(own, 800, 400), "long-texts")
    assert texts.agg(F.sum(F.length("text"))).first()[0] == 800 * 400 * 128
    assert _direct_bytes(spark) - before < 15_000_000


def test_texts_that_become_longer_keep_no_large_pages(spark):
    own, before = spark.newSession(), _direct_bytes(spark)
    texts = saved(_texts(own, 4000, "if(id % 2000 < 1000, 1, 200)"), "longer-texts")
    assert texts.agg(F.sum(F.length("text"))).first()[0] == 2000 * 201 * 128
    assert _direct_bytes(spark) - before < 15_000_000


def test_a_deployment_may_set_how_parquet_is_read_and_written(spark):
    own = spark.newSession()
    own.conf.set("parquet.hadoop.vectored.io.enabled", "true")
    own.conf.set("spark.hadoop.parquet.page.size.row.check.min", "5")
    saved(own.range(3), "three")
    assert own.conf.get("parquet.hadoop.vectored.io.enabled") == "true"
    assert own.conf.get("parquet.page.size.row.check.min", None) is None
    assert own.conf.get("parquet.page.size.check.estimate") == "false"


def test_shingles_of_many_texts_need_little_at_a_time():
    texts = pa.array([" ".join(f"w{k}x{i}" for i in range(300)) for k in range(1000)])
    count = sum(len(s) for s in shingle_sets(texts.slice(0, 1), 5))
    tracemalloc.start()
    assert sum(len(s) for s in shingle_sets(texts, 5)) == 1000 * count == 296_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000


def test_empty_and_linkless_tables_join(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert link_components(empty).count() == 0
    alone = spark.createDataFrame([(5, "one"), (6, "two words")], "doc_id int, text string")
    assert {tuple(r) for r in link_components(alone).collect()} == {(5, 1, 5), (6, 1, 6)}


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(None, 3), (50, 50)]
    found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {found[k] for k in range(100, 161)} == {100} and {found[k] for k in range(7, 40)} == {7} and found[50] == 50


def test_top_products_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=6) * rng.choice([0.01, 1, 5])]) for i in range(3000)]
    rows += [(5000 + i, rows[50][1]) for i in range(20)] + [(50, rows[50][1])]
    odd = [(6000, None), (6050, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (6100, [float("nan")] * 6), (6150, [float("inf")] * 6), (6200, []), (None, [1.0] * 6), (6250, [1.0, 2.0]), (6300, [0.0] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumn("v", F.lit("x")).withColumn("score", F.lit(0))
    found = defaultdict(list)
    for r in top_products(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    usable = [*rows, (6300, [0.0] * 6)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in usable]
    queries = {i: v for i, v in whole if i % 50 == 0}
    assert set(found) == set(queries)
    for q, v in queries.items():
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q))[:5]
        assert found[q] == [(i, -s) for s, i in scores]
    assert top_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_huge_components_do_not_break_the_search(spark):
    df = spark.createDataFrame([(0, [1e30, 0.0]), (1, [1e30, 1.0]), (2, [-1e30, 0.0])], "vec_id int, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in top_products(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]


def test_neighbours_are_found(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(4000 + i, rows[7][1]) for i in range(300)]
    odd = [(9000, None), (9100, [0.0] * 24), (9200, [float("nan")] * 24), (9300, [1.0]), (None, [1.0] * 24), (9400, [])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumn("v", F.lit("x")).withColumn("key", F.lit(1))
    found = defaultdict(list)
    for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = []
    assert set(found) == {i for i, _ in rows if i % 100 == 0}
    for q, near in found.items():
        d = np.sqrt(((m - m[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        hits.append(len({i for i, _ in near} & set(ids[order].tolist())) / 10)
        assert all(math.isclose(s, d[np.flatnonzero(ids == i)[0]], abs_tol=1e-12) for i, s in near)
    assert np.mean(hits) >= 0.9
    assert found[4000] == [(i, 0.0) for i in [7, *range(4001, 4010)]]
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (3, [2.0])], "vec_id int, embedding array<float>")
    assert [tuple(r) for r in nearest_neighbours(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 3, 1.0)]
    assert nearest_neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("huge", [1e6, 1e30])
def test_a_huge_vector_does_not_blur_the_others(spark, huge):
    m = np.random.default_rng(3).normal(size=(1500, 16))
    m[1] = huge
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")
    hits = defaultdict(int)
    for r in nearest_neighbours(df, F.col("vec_id") % 50 == 0, 10).collect():
        d = ((m - m[r["query_id"]]) ** 2).sum(1)
        d[r["query_id"]] = np.inf
        hits[r["query_id"]] += r["vec_id"] in np.argsort(d)[:10]
    assert len(hits) == 30 and sum(hits.values()) / 300 >= 0.9


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["big"] * 6 + ["b", "c", "é"]), "w " * int(rng.paretovariate(0.7))) for i in range(4000)]
    rows += [(9001, None, "a b"), (9002, None, None), (9003, "none", ""), (None, "b", "x y"), (9004, "big", "w " * 20), (9004, "big", "w " * 20)]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string").withColumn("copies", F.lit("x")).withColumn("size", F.lit("y"))
    found = mix_sources(df).collect()
    assert len(found) == len(rows)
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 2
    weights = dict(zip([*sorted(s for s in sizes if s is not None), None], [5, 2, 1] * 2, strict=False))
    total, free, level = 1.5 * sum(sizes.values()), set(sizes), 0
    while True:
        level = (total - sum(2 * sizes[s] for s in sizes if s not in free)) / sum(weights[s] for s in free)
        above = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not above:
            break
        free -= above
    for s in sizes:
        assert math.isclose(target[s], level * weights[s] if s in free else 2 * sizes[s])
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    again = {(r["doc_id"], r["size"], r["copies"]) for r in mix_sources(df.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["size"], r["copies"]) for r in found}
    assert mixed_rows(df).count() == sum(r["copies"] for r in found) and mixed_rows(df).columns == df.columns
    assert mix_sources(df.limit(0)).count() == 0


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_steps_of_one(spark, dimensions, bits):
    cells = [F.expr(f"cast((id >> {bits * k}) & {2**bits - 1} as int)").alias(f"c{k}") for k in range(dimensions)]
    grid = spark.range(2 ** (dimensions * bits)).select(*cells)
    rows = sorted(map(tuple, grid.select(hilbert_index([F.col(f"c{k}") for k in range(dimensions)], bits), "*").collect()))
    assert [r[0] for r in rows] == list(range(2 ** (dimensions * bits)))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:], strict=True)) == 1 for p, q in zip(rows, rows[1:], strict=False))


def test_shards_are_even_and_gapless(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice(["é", "x" * 5000, "", "same text", f"t{i}"]), rng.choice(["src1", "src2", None]), rng.choice(["en", "de"]), rng.randrange(9999)) for i in range(1000)]
    rows += [(None, None, None, None, None), (5, "twice", "s", "en", 1), (5, "twice", "s", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, lang string, n_chars int").withColumn("slot", F.lit("x"))
    found = shard_by_curve(df, 24).collect()
    shards = defaultdict(list)
    for r in found:
        shards[r["shard"]].append(r)
    assert len(found) == len(rows) and set(shards) == set(range(24))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values())
    by_slot = [r["curve"] for k in range(24) for r in sorted(shards[k], key=lambda r: r["slot"])]
    assert by_slot == sorted(by_slot)
    content = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found)
    assert content == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert shard_by_curve(df.limit(0)).count() == 0
    write_shards(df, str(tmp_path / "shards"), shards=5)
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().count() == 5


def test_pipeline_stages_keep_their_promises(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(corpus_pipeline.saved(stage(spark, held[-1], sf), name.replace(" ", "-")))
        if stage is not corpus_pipeline.encoded:
            assert held[-1].columns == docs.columns
    raw, good, single, masked, mix, tokens = [[r.asDict() for r in h.collect()] for h in held]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    assert all(i in kept for i, q in labels.items() if q == 1) and sum(i in kept for i, q in labels.items() if q == 0) <= 2
    groups = _components([(r["doc_id"], r["text"]) for r in good], 5, 80)
    assert {r["doc_id"] for r in single} == set(groups.values())
    before = {r["doc_id"]: r for r in single}
    assert {r["doc_id"] for r in masked} == set(before)
    for r in masked:
        assert r["n_chars"] == len(r["text"]) and (r["text"] == before[r["doc_id"]]["text"] or "[SECRET]" in r["text"])
    texts = {r["doc_id"]: r["text"] for r in masked}
    assert max(Counter(r["doc_id"] for r in mix).values()) <= 2 and all(texts[r["doc_id"]] == r["text"] for r in mix)
    assert Counter(r["doc_id"] for r in tokens) == Counter(r["doc_id"] for r in mix)
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in tokens)
    whole = [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(map(repr, whole)) == sorted(map(repr, tokens))
