import json
import random

import pytest
from pyspark.sql import functions as F

from eventmill.functions.paths import field
from eventmill.operators.clean import decode_event_payload, remove_redundant_context, truncate_strings
from eventmill.operators.parse import CUT_LENGTHS, beyond_repair, parse_events, repair_events
from eventmill.operators.privacy import desensitize, tokenize_users
from eventmill.operators.project import json_select, json_select_lines
from eventmill.operators.shape import field_names, flatten, leaves, schema_profile

NESTED = '{"a":{"b":"c","d":{"e":"f","g":"h"},"i":"j"},"k":"l"}'


def test_parse_keeps_objects_only(records, texts):
    assert texts(records('{"a":"b"}', '["c", "d"]', "{}", "plain", '  {"e": 1}\t ')) == [{"a": "b"}, {"e": 1}]


@pytest.mark.parametrize(
    "line",
    ['{"a":1}xyz', '{"a":1} {"b":2}', "{'a':1}", '{"a":1}]', '{"a":1}][{"b":1}', '{"a":1}] [{"b":1}', '{"a":', '{"a":1},{"b":2}', '{"a":01}'],
)
def test_parse_is_as_strict_as_a_decoder(records, line):
    with pytest.raises(ValueError):
        json.loads(line)
    assert records(line).count() == 0


def test_parse_accepts_what_a_decoder_accepts(records, texts):
    good = ['{"a":[[1],[2]],"s":"] ["}', '{"a":1,"a":2}', '{"a":{"b":1,"b":2}}', '{"a":null,"b":true,"c":1.5e3,"d":"\\u00e9"}']
    assert texts(records(*good)) == [json.loads(line) for line in good]


def test_lines_of_a_cut_length_are_dropped_when_asked(lines):
    def line(length):
        return '{"a":"' + "x" * (length - 8) + '"}'

    lengths = [2038, 2039, 2043, 2044, 9979, 9980, 10000, 10001, 31999, 32000, 32999, 33000]
    def kept(**options):
        found = parse_events(lines(*map(line, lengths)), **options).select(F.length(field("a")).alias("n")).collect()
        return {row.n + 8 for row in found}

    assert kept(cut_lengths=CUT_LENGTHS) == {2038, 2044, 9979, 10001, 31999, 33000}
    assert kept() == set(lengths)


def test_letters_outside_ascii_stay(records, texts):
    assert texts(records('{"username":"Zoé"}', 'é{"username":"x"}', ' {"é":"ß"} ')) == [{"username": "Zoé"}, {"é": "ß"}]


def test_repair_completes_cut_lines(lines, texts):
    cut = lines('{"a":{"b":"c', '{"a":1', '{"a":{"b":{"c":"d', '{"a":"b"}', '{"a": zz', "no object")
    assert texts(repair_events(cut)) == [{"a": {"b": "c"}}, {"a": 1}, {"a": {"b": {"c": "d"}}}, {"a": "b"}]
    assert [row.value for row in beyond_repair(cut).collect()] == ['{"a": zz']
    with pytest.raises(Exception, match="beyond repair"):
        repair_events(cut, strict=True).count()
    assert repair_events(lines('{"a":1', '{"b":2}'), strict=True).count() == 2


def test_payload_is_decoded_while_it_is_text(records, texts):
    deep = "1"
    for _ in range(6):
        deep = json.dumps(deep)
    decoded = decode_event_payload(
        records('{"event":"[1,2,3]"}', '{"c":"d"}', '{"event":"{cut"}', json.dumps({"event": deep}), '{"event":{"q":"1"}}', '{"event":"\\"zz\\""}', '{"event":null}')
    )
    assert texts(decoded) == [
        {"event": [1, 2, 3]}, {"c": "d"}, {"event": "Truncated"}, {"event": 1}, {"event": {"q": "1"}}, {"event": "Truncated"}, {"event": None}]


def test_desensitize_removes_listed_fields(records, texts):
    line = '{"username":"Bob","c":"d","event":{"a":"b","password":"foo"},"context":{"username":"Bob","x":1}}'
    assert texts(desensitize(records(line), ["username"], ["password"], "id")) == [
        {"c": "d", "event": {"a": "b"}, "context": {"x": 1}}]


def test_desensitize_replaces_users(records, texts):
    masked = desensitize(records('{"username":"Bob","event":"text"}', '{"username":"Al"}', '{"a":1}', '{"username":"Bob"}'), ["a"], ["b"], "id")
    assert texts(masked) == [{"username": "aaa", "event": "text"}, {"username": "aab"}, {}, {"username": "aaa"}]


def test_redundant_context_goes(records, texts):
    cleaned = remove_redundant_context(
        records(
            '{"username":"bob","context":{"username":"bob","date":"today"}}',
            '{"username":"bob","context":{"username":"bob","course_user_tags":{"a":1}}}',
            '{"username":"bob","context":{"username":"al"}}', '{"context":"text"}', '{"context":null}', '{"context":{}}', '{"a":1,"context":{"a":"1"}}',
        )
    )
    assert texts(cleaned) == [
        {"username": "bob", "context": {"date": "today"}}, {"username": "bob"}, {"username": "bob", "context": {"username": "al"}},
        {"context": "text"}, {"context": None}, {}, {"a": 1, "context": {"a": "1"}}]


def test_long_strings_become_null(records, texts):
    assert texts(truncate_strings(records('{"a":"12345","b":"123"}', '{"c":["1",2,"12345"]}'), 4)) == [
        {"a": None, "b": "123"}, {"c": ["1", 2, None]}]


def test_no_long_string_is_left(records, texts):
    chance = random.Random(5)
    alphabet = 'ab"\\\n\té/{}[]:,'

    def value(depth):
        kind = chance.choice("sssnld" if depth else "ssn")
        if kind == "s":
            return "".join(chance.choice(alphabet) for _ in range(chance.randrange(9)))
        if kind == "n":
            return chance.choice([1, 123456789, 2.5, True, None])
        if kind == "l":
            return [value(depth - 1) for _ in range(chance.randrange(4))]
        return {f"key number {i}": value(depth - 1) for i in range(chance.randrange(4))}

    def short(item):
        if isinstance(item, dict):
            return {k: short(v) for k, v in item.items()}
        if isinstance(item, list):
            return [short(v) for v in item]
        return None if isinstance(item, str) and len(item) > 4 else item

    made = [{"x": value(3), "y": value(2)} for _ in range(60)]
    assert texts(truncate_strings(records(*map(json.dumps, made)), 4)) == [short(record) for record in made]


def test_very_long_strings_do_not_overflow(records, texts):
    line = json.dumps({"a": {"b": '\\"' * 60000, "c": "x" * 90000, "d": "ok"}})
    assert texts(truncate_strings(records(line), 100)) == [{"a": {"b": None, "c": None, "d": "ok"}}]


def test_field_names_and_flat_records(records, texts):
    assert {row.path for row in field_names(records(NESTED)).collect()} == {"k", "a.d.g", "a.i", "a.b", "a.d.e"}
    assert texts(flatten(records(NESTED))) == [{"k": "l", "a.d.g": "h", "a.i": "j", "a.b": "c", "a.d.e": "f"}]
    assert texts(flatten(records('{"a":{},"b":[{"c":1}],"d":null}'))) == [{"b": [{"c": 1}], "d": None}]


def test_flatten_keeps_every_leaf(records, texts):
    chance = random.Random(3)

    def tree(depth):
        return {f"k{i}": tree(depth - 1) if depth and chance.random() < 0.5 else i for i in range(chance.randrange(1, 4))}

    def count(node):
        return sum(count(v) if isinstance(v, dict) else 1 for v in node.values())

    made = [tree(7) for _ in range(30)]
    assert [len(flat) for flat in texts(flatten(records(*map(json.dumps, made))))] == [count(record) for record in made]


def test_a_record_deeper_than_stated_is_an_error(records):
    assert leaves(records(NESTED), levels=3).select(F.size("leaves")).first()[0] == 5
    with pytest.raises(Exception, match="deeper than 2 levels at a.d"):
        leaves(records(NESTED), levels=2).collect()


def test_schema_profile_shows_the_last_example(records):
    profile = schema_profile(records('{"a":1,"x":{"answers":1}}', '{"a":[2],"event":"{\\"b\\":3}"}', '{"POST":1}'), "id")
    assert [tuple(row)[:3] for row in profile.collect()] == [("a", 2, "[2]"), ("event.b", 1, "3")]
    assert [(row.types, row.schema) for row in profile.collect()] == [("array,number", "VARIANT"), ("number", "BIGINT")]


def test_the_walk_is_one_pass(records, spark):
    walked = field_names(records(NESTED, '{"deep": ' * 40 + "1" + "}" * 40))
    plan = walked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 or plan.count("JsonToStructs") <= 2
    assert ".".join(["deep"] * 40) in {row.path for row in walked.collect()}


def test_schema_profile_sorts_no_leaves(spark, records):
    rows = [f'{{"a":{i},"deep":{{"b":{{"c":{{"d":"{i}"}}}}}},"n":null}}' for i in range(50)]
    profile = schema_profile(records(*rows), "id").select("path", "records", "example")
    assert [tuple(row) for row in profile.collect()] == [("a", 50, "49"), ("deep.b.c.d", 50, '"49"'), ("n", 50, "null")]
    # leaves are counted in numbers, and only records that come last are walked for their text
    plan = profile._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("LeftSemi") > plan.index("Generate explode(filter(leaves")


def test_schema_profile_of_missing_and_repeated_ordinals(spark, lines):
    made = lines('{"a":1}', '{"a":"x","b":[1]}').select(F.when(F.col("id") < 0, 1).alias("id"), "value")
    made = made.union(spark.createDataFrame([(3, '{"c":1.5}'), (3, '{"c":2}')], "id int, value string"))
    found = schema_profile(parse_events(made), "id").collect()
    assert [(r.path, r.records, r.types) for r in found] == [("a", 2, "number,string"), ("b", 1, "array"), ("c", 2, "number")]
    assert [r.example for r in found][:2] == [None, None] and found[2].example in ("1.5", "2")


def test_a_flat_record_that_is_exploded_is_walked_once(records):
    plan = flatten(records(NESTED)).select(F.explode("rec"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries(leaves") == 1 and plan.count("AS leaves") == 1


def test_an_open_record_is_walked_to_its_end_whatever_its_depth(records, texts):
    made = [{"a": {}}, {"a": {"b": {"c": {"d": {}, "e": "{{"}}, "f": [{"g": {}}]}}, {"x": "{{{{", "y": {"z": {"v": {"w": None}}}}]
    wanted = [{}, {"a.b.c.e": "{{", "a.f": [{"g": {}}]}, {"x": "{{{{", "y.z.v.w": None}]
    assert texts(flatten(records(*map(json.dumps, made)))) == wanted
    assert texts(flatten(records(*map(json.dumps, made)), levels=5)) == wanted


def test_payloads_encoded_many_times_are_decoded(records, texts):
    from eventmill.operators.clean import decode_event_payload

    made = []
    for times in range(9):
        for payload in ('""', '{"k":1}', "7", '"x'):
            for _ in range(times):
                payload = json.dumps(payload)
            made.append({"event": payload})
    decoded = [row["event"] for row in texts(decode_event_payload(records(*map(json.dumps, made))))]
    assert decoded == ["Truncated", {"k": 1}, 7, "Truncated"] * 9


def test_empty_records_are_empty_lines(lines):
    shown = json_select_lines(lines('{"a":1}', "{}", "[]", "x", '{"b":2}', '{"a":"t"} '), ["a"])
    assert [row.value for row in shown.orderBy("id").collect()] == ["1", "", "", "t"]


def test_json_select_prints_present_values(records):
    shown = json_select(records('{"a":"x y","b":null,"c":true}', '{"d":1}'), ["a", "b", "c"])
    assert [row.text for row in shown.orderBy("id").collect()] == ["x y None True", ""]


def test_tokens_are_stable_and_distinct(spark):
    names = [str(i) for i in range(100)] * 2
    frame = spark.createDataFrame(list(enumerate(names)), "id bigint, user string")
    tokens = [row.user for row in tokenize_users(frame, "user", "id").orderBy("id").collect()]
    assert tokens[:100] == tokens[100:] and len(set(tokens)) == 100
    assert tokens[:3] == ["aaa", "aab", "aac"] and tokens[52] == "aba"


def test_too_many_users_is_an_error(spark):
    frame = spark.range(20).selectExpr("id", "cast(id AS string) AS user")
    assert len(tokenize_users(frame, "user", "id", capacity=20).collect()) == 20
    with pytest.raises(Exception, match="more than 19 users"):
        tokenize_users(frame, "user", "id", capacity=19).collect()


def test_parsing_happens_once_below_a_filter(records):
    plan = records('{"a":"1"}').where(field("a") == "1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(ArrayType") == 1
