import random

import pytest
from pyspark.sql import functions as F

from eventmill.functions.courses import canonical_course
from eventmill.functions.events import event_date, source_institution
from eventmill.functions.identity import all_short_hashes, short_hash
from eventmill.functions.plain_text import ascii_fold, entity_text
from eventmill.functions.typed import clean_header, clean_name, parse_dollars, parse_int
from eventmill.operators.counts import event_count, field_set, item_count_probe, proportion_bounds, users_count
from eventmill.operators.filters import date_gt, filter_events, filter_fields, parse_cutoff
from eventmill.functions.grams import AT_ONCE
from eventmill.operators.joins import filter_lines_by_users, lookup_join
from eventmill.operators.ordering import big_sort, merge_sorted, number_rows
from eventmill.operators.privacy import tokenize_users
from eventmill.operators.project import map_keep_truthy


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def test_short_hashes(spark):
    hashes = [row[0] for row in column(spark, ["Eve", "Eve", "Alice", "Bob", "Hello"]).select(short_hash(F.col("c"))).collect()]
    assert hashes[0] == hashes[1] and hashes[2] != hashes[3] and {len(h) for h in hashes} == {3}
    every = [row.shard for row in all_short_hashes(spark, 3).collect()]
    assert len(set(every)) == 4096 and hashes[4] in every
    assert "aa" in [row.shard for row in all_short_hashes(spark, 2).collect()]


@pytest.mark.parametrize(
    "course, canonical",
    [
        ("course-v1:KyotoUx+002x+1T2016", "KyotoUx/002x/2016T1"), ("PekingX/02132750x/2015Q1", "PekingX/02132750x/2015T1"),
        ("i4x://PekingX/02132750x/2015Q1", "PekingX/02132750x/2015T1"), ("ccx-v1:a+b+T12016@ccx@1", "a/b/2016T1"),
        ("a/b/X", "a/b/2016"), ("a/b", "a/b"), ("a/b/2015_Q-3B", "a/b/2015T3"), ("a/b/2T", "a/b/T2"), ("a/b/1T2016/c", "a/b/2016T1/c"),
    ],
)
def test_canonical_course(spark, course, canonical):
    assert column(spark, [course]).select(canonical_course(F.col("c"))).first()[0] == canonical


def test_a_course_without_run_fails_when_strict(spark):
    with pytest.raises(Exception, match="without a run"):
        column(spark, ["a/b"]).select(canonical_course(F.col("c"), strict=True)).collect()


def test_source_institution(spark):
    rows = [
        ("server", "/courses/OrgX/6/about", None, None), ("server", "/dashboard", None, None), ("server", "check", None, "i4x:/a/OrgX/p"),
        ("server", "check", None, None), ("browser", None, "http://h/courses/OrgX/6", None), ("browser", None, "http://h/", None),
        ("browser", None, "http://courses/", None), ("mobile", "x", "y", "z"),
    ]
    frame = spark.createDataFrame(rows, "s string, k string, p string, i string")
    found = frame.select(source_institution(*[F.col(c) for c in "skpi"])).collect()
    assert [row[0] for row in found] == ["OrgX", "Global", "OrgX", "Unhandled", "OrgX", "BGE", None, None]


def test_event_date(spark):
    assert [r[0] for r in column(spark, ["2014-01-02T03:04", None]).select(event_date(F.col("c"))).collect()] == ["2014-01-02", "XX"]


def test_names_and_typed_text(spark):
    assert clean_header(" GDP - per capita (PPP) ") == "GDP_per_capita_PPP"
    assert column(spark, ["a--b", "_x_ é"]).select(clean_name(F.col("c")).alias("n")).collect() == [("a_b",), ("x",)]
    assert [r[0] for r in column(spark, ["$ 1 200", "", None]).select(parse_dollars(F.col("c"))).collect()] == [1200, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        column(spark, ["x"]).select(parse_int(F.col("c"))).collect()
    assert column(spark, ["x"]).select(parse_int(F.col("c"), lenient=True)).first()[0] is None


def test_entities_and_folding(spark):
    entities = {"&amp;": "&", "&#8217;": "'", "&#x41;": "A", "&eacute;": "e", "&Eacute;": "É", "&foo;": "&foo;", "&#128512;": "😀", "&T": "&T;", "&lrm;": ""}
    found = column(spark, list(entities)).select(entity_text(F.col("c"))).collect()
    assert [row[0] for row in found] == list(entities.values())
    assert column(spark, ["Öl — “straße” œuvre ñ 中 ©"]).select(ascii_fold(F.col("c"))).first()[0] == 'Ol -- "strasse" oeuvre n  (C)'


def test_cutoffs(spark):
    assert {parse_cutoff(d).isoformat() for d in ("2014-01-02", "Jan 2 2014", "2 Jan 2014", "2014/01/02")} == {"2014-01-02T00:00:00"}
    frame = spark.createDataFrame([("2014-01-02T00:00:00+00:00",), ("2014-01-02T00:00:01+00:00",), (None,), ("bad",)], "time string")
    assert date_gt(frame, None).count() == 4
    assert [row.time for row in date_gt(frame, "Jan 2, 2014").collect()] == ["2014-01-02T00:00:01+00:00"]


def test_filter_on_fields_with_missing_values(records):
    frame = records('{"a":"x","b":{"c":"y"}}', '{"a":"x"}', '{"a":"z"}')
    assert [r.id for r in filter_fields(frame, {"a": ["x"], "b:c": [None, "q"]}).collect()] == [1]
    assert [r.id for r in filter_fields(frame, {"a": ["x"], "b:c": ["y"]}).collect()] == [0]


def test_truthy_rows_stay(spark):
    assert [r.d for r in map_keep_truthy(column(spark, [0, 1, None, 3], "int"), F.col("c") - 1, "d").collect()] == [-1, 2]
    assert map_keep_truthy(column(spark, ["", "a", None]), F.col("c"), "d").count() == 1


def test_counts(records):
    frame = records('{"username":"a"}', '{"username":"a"}', '{"x":1}', '{"username":"b"}')
    assert event_count(frame).first()[0] == 4
    assert users_count(frame).first()[0] == 3 and users_count(frame, include_missing=False).first()[0] == 2
    assert {row[0] for row in field_set(frame, "username").collect()} == {"a", "b", None}
    passing, observation = item_count_probe(frame, "label")
    passing.collect()
    assert observation.get["rows"] == 4


def _grid_bounds(n, k):
    import numpy as np

    phi = np.arange(1001) / 1000
    weight = phi**k * ((1000 - np.arange(1001)) / 1000) ** (n - k)
    order = np.lexsort((np.arange(1001), -weight))
    mass = np.cumsum(weight[order] / weight.sum())
    taken = order[: np.searchsorted(mass, 0.95) + 1]
    return phi[taken.min()], phi[order[0]], phi[taken.max()]


def test_proportion_bounds(spark):
    cases = [(10, 3), (10, 5), (20, 0), (7, 7), (500, 39), (60, 20), (1, 0), (1000, 17)]
    found = proportion_bounds(spark.createDataFrame(cases, "n int, k int")).collect()
    assert [tuple(round(x, 3) for x in row[2:]) for row in found] == [tuple(round(float(x), 3) for x in _grid_bounds(*c)) for c in cases]
    assert tuple(found[0][2:]) == (0.094, 0.3, 0.588)
    low, mode, high = proportion_bounds(spark.createDataFrame([(500, 100)], "n int, k int")).first()[2:]
    assert (round(low, 4), mode, round(high, 4)) == (0.1649, 0.2, 0.2351)


def test_names_across_the_parts_of_a_long_line(spark):
    name = "abcdefghijklmnopqrstuvwxyz"
    users = spark.createDataFrame([(name,), ("zzz",)], "username string")
    for before in range(AT_ONCE - 27, AT_ONCE + 1, 3):
        line = "d" * before + name + "d" * 50
        assert filter_lines_by_users(column(spark, [line, "d" * 99]), users, "c", few=0).count() == 1


def test_misses_never_become_rows(spark):
    frame, users = column(spark, ["nothing here"] * 50 + ["a name1 b"]), spark.createDataFrame([(f"name{i}",) for i in range(40)], "username string")
    found = filter_lines_by_users(frame, users, "c")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and found.collect() == [("a name1 b",)]


def test_all_ways_to_find_users_agree(spark):
    chance = random.Random(1)
    names = ["".join(chance.choice("abc") for _ in range(chance.randrange(3, 7))) for _ in range(40)] + ["é x", " pad ", ""]
    text = ["".join(chance.choice("abcd é") for _ in range(chance.randrange(0, 700))) for _ in range(300)] + ["abc", "xxpad", "é xx"] * 30
    names += ["abcabcabcabcabcabcab" + c for c in "abc"]
    text += ["d" * n + names[-1] + "d" * 300 for n in range(225, 275)]
    frame, users = column(spark, text + [None]), spark.createDataFrame([(n,) for n in names], "username string")
    for few, number, automaton in ((0, 3, False), (0, 50, False), (100, 50, False), (0, 50, True)):
        some = users.limit(number)
        wanted = [n.strip() for n in names[:number] if n.strip()]
        expected = sorted(t for t in text if any(n in t for n in wanted))
        found = filter_lines_by_users(frame, some, "c", few=few, automaton=automaton)
        assert sorted(row.c for row in found.collect()) == expected
    # a shuffled list gives the same as a broadcast one, and a repeated line is found as often as it is there
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert sorted(row.c for row in filter_lines_by_users(frame, users, "c", few=0).collect()) == sorted(
            t for t in text if any(n.strip() in t for n in names if n.strip()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for how in ({}, {"few": 0}, {"automaton": True}):
        assert filter_lines_by_users(frame, users.limit(0), "c", **how).count() == 0


def test_lookup_of_a_missing_name(spark):
    table = spark.createDataFrame([("a", "1")], "c string, v string")
    assert lookup_join(column(spark, ["a"]), table, "c", "v").collect() == [("a", "1")]
    assert lookup_join(column(spark, ["b"]), table, "c", "v", strict=False).first()["v"] is None
    with pytest.raises(Exception, match="no v for b"):
        lookup_join(column(spark, ["a", "b"]), table, "c", "v").collect()


def test_big_sort_of_unique_lines(spark):
    import uuid

    lines = [str(uuid.uuid4()) for _ in range(10_000)]
    found = [row.c for row in big_sort(column(spark, lines), F.substring("c", 1, 2), "c").collect()]
    assert found == sorted(lines)


def test_rows_are_numbered_in_order(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.lit("hot").alias("user"))
    assert number_rows(frame, "user", "x").where("x <> position").count() == 0


def test_merge_of_sorted_frames(spark):
    chance = random.Random(2)
    lists = [sorted((chance.randrange(50) for _ in range(10)), reverse=True) for _ in range(3)] + [[]]
    merged = merge_sorted([column(spark, values, "int") for values in lists], "c")
    assert [row.c for row in merged.collect()] == sorted(sum(lists, []), reverse=True)


def test_merged_rows_with_equal_keys_keep_input_and_place(spark):
    chance = random.Random(2)
    inputs = [sorted(((chance.randrange(4), i, place) for place in range(200)), key=lambda r: -r[0]) for i in range(3)]
    inputs = [[(key, i, n) for n, (key, i, _) in enumerate(rows)] for rows in inputs]
    expected = sorted(sum(inputs, []), key=lambda r: (-r[0], r[1], r[2]))
    for parts in (1, 7, 7):
        frames = [spark.createDataFrame(rows, "k int, input int, n int").repartition(parts) for rows in inputs]
        assert [tuple(r) for r in merge_sorted(frames, "k", "n").collect()] == expected
    # without an ordinal, rows keep the order they are read in
    frames = [spark.createDataFrame(rows, "k int, input int, n int").coalesce(2) for rows in inputs]
    assert [tuple(r) for r in merge_sorted(frames, "k").collect()] == expected


def test_filters_on_plain_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.sql("SELECT timestamp_ntz'2024-01-02' AS time, 'a' AS event_type, 1 AS other").write.parquet(path)
    chosen = filter_events(date_gt(spark.read.parquet(path), "2024-01-01"), ["a", "b"]).select("event_type")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(time" in plan and "In(event_type" in plan and "other" not in plan
    assert chosen.count() == 1


def test_events_are_not_shuffled_for_tokens(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.sql("SELECT 1L AS id, 'a' AS user, 'x' AS more").write.parquet(path)
    plan = tokenize_users(spark.read.parquet(path), "user", "id")._jdf.queryExecution().executedPlan().toString()
    # one exchange, of users reduced to their first id
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
