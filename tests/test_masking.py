"""What masking, tokens, lookups and filters promise beyond the plain cases."""

import pytest
from pyspark.sql import functions as F

from eventmill.functions.paths import field
from eventmill.functions.plain_text import entity_text
from eventmill.operators.filters import filter_courses, filter_fields
from eventmill.operators.joins import lookup_join
from eventmill.operators.ordering import number_rows, sort_events
from eventmill.operators.privacy import desensitize, tokenize_users
from eventmill.operators.project import map_keep_truthy
from eventmill.sources.cached import cache_events, read_cached_events, with_hot_columns


def test_plain_columns_are_masked_with_the_record(records):
    frame = with_hot_columns(records('{"username":"Zoé","ip":"1"}', '{"ip":"2"}')).withColumn("ip", field("ip"))
    rows = desensitize(frame, ["ip"], [], "id").orderBy("id").select("*", field("username").alias("inner")).collect()
    assert [(r["username"], r["inner"]) for r in rows] == [("aaa", "aaa"), (None, None)]
    assert "ip" not in rows[0].asDict()
    assert "username" not in desensitize(frame, ["username"], [], "id").columns


def test_wide_tokens_are_all_different(spark):
    users = spark.range(150_000).select("id", F.concat(F.lit("u"), "id").alias("user"))
    named = tokenize_users(users, "user", "id", width=4)
    assert named.select(F.count_distinct("user"), F.min(F.length("user"))).first()[:] == (150_000, 4)
    assert named.where("id IN (0, 52, 140608)").orderBy("id").select("user").collect() == [("aaaa",), ("aaba",), ("baaa",)]
    with pytest.raises(ValueError, match="140608"):
        tokenize_users(users, "user", "id", capacity=200_000)


def test_lookups_of_repeated_and_null_values(spark):
    table = spark.createDataFrame([("a", 1), ("b", None), ("c", 1), ("c", 2)], "name string, v int")
    frame = spark.createDataFrame([("a",), ("b",)], "name string")
    assert sorted(map(tuple, lookup_join(frame, table, "name", "v").collect())) == [("a", 1), ("b", None)]
    with pytest.raises(Exception, match="more than one v for c"):
        lookup_join(spark.createDataFrame([("c",)], "name string"), table, "name", "v").collect()


def test_specs_compare_by_type(records):
    frame = records('{"n":5}', '{"n":"5"}', '{"n":5.0}', '{"n":true}', '{"n":"x"}', '{"m":1}')
    ids = lambda spec: [r["id"] for r in filter_fields(frame, spec).orderBy("id").collect()]
    assert ids({"n": [5]}) == [0, 2]
    assert ids({"n": ["5", "x"]}) == [1, 4]
    assert ids({"n": [True, None]}) == [3, 5]


def test_course_filter_reaches_the_scan_of_a_cache(spark, records, tmp_path):
    path = str(tmp_path / "cache")
    cache_events(records('{"context":{"course_id":"a"}}', '{"context":{"course_id":"b"}}'), path)
    chosen = filter_courses(read_cached_events(spark, path), ["a"])
    assert [r["id"] for r in chosen.collect()] == [0]
    assert "EqualTo(course_id,a)" in chosen._jdf.queryExecution().toString()


def test_entities_with_leading_zeros(spark):
    frame = spark.createDataFrame([("&#0000000000065;",), ("&#x00000000041;",)], "e string")
    assert [r[0] for r in frame.select(entity_text(F.col("e"))).collect()] == ["A", "A"]


def test_numbers_follow_the_order_given(spark):
    frame = spark.range(100).select(((F.col("id") * 37) % 100).alias("k"))
    numbered = number_rows(sort_events(frame, ["k"])).collect()
    assert all(r["k"] == r["position"] for r in numbered)
    backwards = number_rows(frame.orderBy(F.col("k").desc())).collect()
    assert all(r["k"] == 99 - r["position"] for r in backwards)


def test_a_mapped_expression_is_computed_once(spark):
    frame = map_keep_truthy(spark.range(5), F.expr("id % 2"), "odd")
    assert frame.count() == 2
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("% 2") == 1
