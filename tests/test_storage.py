import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from eventmill.functions.identity import short_hash
from eventmill.functions.paths import field
from eventmill.operators.clean import decode_event_payload, remove_redundant_context, truncate_strings
from eventmill.operators.counts import event_count, field_set, item_count_probe, users_count
from eventmill.operators.filters import date_gt, filter_courses, filter_events, filter_fields, select_in
from eventmill.operators.joins import filter_lines_by_users
from eventmill.operators.parse import parse_events, repair_events
from eventmill.operators.privacy import drop_fields
from eventmill.operators.project import json_select, select_fields
from eventmill.operators.shape import flatten
from eventmill.plans.logs import desensitize_to, filter_log_by_users, sort_log
from eventmill.session import scratch_path
from eventmill.sources import cached, files, lines as line_files, shards
from eventmill.sources import by_content
from eventmill.streaming import ingest

LOG = [
    json.dumps({
        "username": f"u{i % 7}", "event_type": "abc"[i % 3], "time": f"2014-01-{i % 28 + 1:02d}T00:00:00", "ip": "1",
        "event": json.dumps({"k": i}) if i % 2 else {"k": i, "session": "s"}, "context": {"ip": "1", "course_id": f"c{i % 4}"},
    })
    for i in range(60)
] + ["[1]", "junk", '{"username": "u1", "event_type": "a', "{}"]


def _folder(tmp_path, name, values):
    folder = tmp_path / name
    folder.mkdir()
    with gzip.open(folder / "log.gz", "wt") as out:
        out.write("\n".join(values) + "\n")
    return str(folder)


def test_only_gz_files_are_read(spark, tmp_path):
    folder = _folder(tmp_path, "in", ["a", "bé"])
    (tmp_path / "in" / "notes.txt").write_text("c\n")
    assert sorted(r.value for r in line_files.read_lines(spark, folder, only_gz=True).collect()) == ["a", "b"]
    assert line_files.read_lines(spark, folder, ascii=False).count() == 3


def test_plain_text_named_gz_is_read(spark, tmp_path):
    folder = _folder(tmp_path, "in", ["a", "", "é"])
    (tmp_path / "in" / "plain.gz").write_bytes(b"x\r\ny\rz")
    (tmp_path / "in" / "empty.gz").write_text("")
    (tmp_path / "in" / "short.gz").write_text("q")
    (tmp_path / "in" / "two.gz").write_bytes(gzip.compress(b"m1\nm") + gzip.compress(b"2\n") + b"\0\0")
    (tmp_path / "in" / "other.txt").write_text("t\n\n")
    found = line_files.read_lines(spark, folder, ascii=False, by_content=True, file_column="file").collect()
    assert sorted(r.value for r in found) == sorted(["a", "", "é", "x", "y", "z", "q", "m1", "m2", "t", ""])
    assert {r.file.rsplit("/", 1)[1] for r in found if r.value == "m2"} == {"two.gz"}
    (tmp_path / "in" / "cut.gz").write_bytes(gzip.compress(b"abc" * 5000)[:20])
    with pytest.raises(Exception, match="cut off"):
        line_files.read_lines(spark, folder, by_content=True).collect()


def test_pieces_of_any_size_give_the_lines(monkeypatch):
    import random

    monkeypatch.setattr(by_content, "AT_ONCE", 7)
    chance = random.Random(3)
    for _ in range(200):
        text = "".join(chance.choice("ab\r\né") for _ in range(chance.randrange(60))).encode()
        expected = re.split(rb"\r\n|\r|\n", text)
        expected = expected[:-1] if expected[-1] == b"" else expected
        for data in (text, gzip.compress(text)):
            reader, found, at = by_content.FileLines("x.gz"), [], 0
            while at < len(data):
                to = at + chance.randrange(1, 9)
                found += sum(reader.feed(data[at:to]), [])
                at = to
            assert found + reader.finish() == expected


def test_misnamed_files_between_real_ones_are_ingested_once(spark, tmp_path):
    folder, out, checkpoint = _folder(tmp_path, "in", ["a", "b"]), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    (tmp_path / "in" / "plain.gz").write_text("p1\np2\n")
    for _ in range(2):
        ingest.incremental_ingest(spark, folder, out, checkpoint, only_gz=True).awaitTermination()
        assert sorted(r.value for r in spark.read.parquet(out).collect()) == ["a", "b", "p1", "p2"]
    (tmp_path / "in" / "more.gz").write_text("p3\n")
    (tmp_path / "in" / "real.gz").write_bytes(gzip.compress(b"c\n"))
    ingest.incremental_ingest(spark, folder, out, checkpoint, only_gz=True).awaitTermination()
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "p1", "p2", "p3"]


def test_delimiters_are_plain_text(spark, lines):
    fields = line_files.split_delimited(lines('a|"b|c"|', ""), "|").collect()
    assert [r.fields for r in fields] == [["a", '"b', 'c"', ""], [""]]


def test_parts_hold_a_limited_number_of_lines(spark, tmp_path):
    line_files.save_events(spark.range(0, 2500, 1, 1).selectExpr("string(id) AS value"), str(tmp_path / "out"), most=1000)
    parts = sorted((tmp_path / "out").glob("*.gz"))
    assert [len(gzip.open(part, "rt").readlines()) for part in parts] == [1000, 1000, 500]


def test_a_shard_is_found_without_listing_the_others(spark, tmp_path):
    for run, names in (("one", ["abc", "ab1"]), ("two", ["ab1"])):
        for name in names:
            spark.createDataFrame([(f"{run}-{name}",)], "value string").write.text(str(tmp_path / run / f"shard={name}"))
    runs = [str(tmp_path / "one"), str(tmp_path / "two")]
    found = shards.read_shard(spark, "abc", runs)
    assert [row.value for row in found.collect()] == ["one-abc"] and found.columns == ["value"]
    assert sorted(row.value for row in shards.read_shard(spark, "ab1", runs).collect()) == ["one-ab1", "two-ab1"]
    assert shards.read_shard(spark, "fff", runs).count() == 0
    # folders of other shards are not listed
    assert found.inputFiles() and all("/shard=abc/" in file for file in found.inputFiles())


def test_few_pieces_are_spread_over_more_tasks_than_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    made = line_files.spread(spark.range(0, 1000, 1, 1).selectExpr("string(id) AS value"))
    assert made.rdd.getNumPartitions() > cores and made.count() == 1000


def test_shards_with_names_like_numbers(spark, tmp_path):
    users = [f"user{i}" for i in range(4000)]
    frame = spark.createDataFrame([(u,) for u in users], "user string")
    shard = {r.user: r.h for r in frame.select("user", short_hash(F.col("user")).alias("h")).collect()}
    odd = [u for u in users if shard[u].isdigit() or "e" in shard[u][1:2]][:40]
    made = parse_events(frame.where(F.col("user").isin(odd)).selectExpr("""concat('{"b":1,"username":"', user, '"}') AS value"""))
    runs = [str(tmp_path / "one"), str(tmp_path / "two")]
    shards.shard_by_user(made, runs[0])
    shards.shard_by_user(made.where(field("username") != odd[0]), runs[1])
    assert {r.shard for r in shards.read_shards(spark, runs).collect()} == {shard[u] for u in odd}
    same = [u for u in odd if shard[u] == shard[odd[0]]]
    found = shards.read_shard(spark, shard[odd[0]], runs)
    assert found.count() == 2 * len(same) - 1
    assert "PartitionFilters: [isnotnull(shard" in found._jdf.queryExecution().executedPlan().toString()
    assert json.loads(found.first()["value"]) == {"b": 1, "username": odd[0]}


def test_a_busy_user_is_spread_over_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        busy = spark.range(0, 40000, 1, 8).selectExpr("'hot' AS shard", "sha2(string(id), 256) AS value")
        shards.write_shards(busy, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "out" / "shard=hot").glob("*.gz"))) > 1
    assert shards.read_shards(spark, [str(tmp_path / "out")]).count() == 40000


def test_id_zero_is_in_no_chunk(spark):
    frame = spark.createDataFrame([(0,), (1,), (10,), (11,)], "id bigint")
    chunks = shards.id_chunks(frame, "id", F.lit(True), ["id"], 10)
    assert sorted(tuple(r) for r in chunks.collect()) == [(0, 1), (0, 10), (1, 11)]


def test_manifest_takes_a_file_once(spark, tmp_path):
    _folder(tmp_path, "in", ["a"])
    store = str(tmp_path / "store")
    assert files.incremental_manifest(files.file_manifest(spark, str(tmp_path / "in"), ".gz"), store).count() == 1
    (tmp_path / "in" / "second.gz").write_bytes(gzip.compress(b"b\n"))
    manifest = files.incremental_manifest(files.file_manifest(spark, str(tmp_path / "in"), ".gz"), store)
    assert manifest.count() == 2 and manifest.select("id").distinct().count() == 2
    sizes = {r.prefix: r.bytes for r in files.path_sizes(manifest, F.element_at(F.split("path", "/"), -1)).collect()}
    assert len(sizes) == 3 and sizes["Total"] == sum(v for k, v in sizes.items() if k != "Total")


def test_materialized_once(spark, tmp_path):
    path = str(tmp_path / "out")
    assert cached.materialize_once(spark.range(3), path).count() == 3
    assert cached.materialize_once(spark.range(9), path).count() == 3


def test_masked_logs_in_both_formats(spark, tmp_path, lines):
    frame = lines(*LOG)
    for kind in ("json", "parquet"):
        desensitize_to(frame, "id", str(tmp_path / kind), format=kind)
    masked = parse_events(line_files.read_lines(spark, str(tmp_path / "json")))
    assert masked.count() == cached.read_cached_events(spark, str(tmp_path / "parquet")).count() == 60
    assert {r[0] for r in masked.select(field("username")).distinct().collect()} == {f"aa{c}" for c in "abcdefg"}
    assert masked.where("map_contains_key(rec, 'ip') OR rec['event'] IS NULL").count() == 0
    with pytest.raises(ValueError):
        desensitize_to(frame, "id", str(tmp_path / "other"), format="bson")


def test_lines_of_users_stay_with_their_file(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for name, values in (("a", ["x u1", "é u2", "none"]), ("b", ["none"]), ("c", ["u1"])):
        _folder(tmp_path / "logs", name, values)
    users = spark.createDataFrame([(" u1",), ("u2",), ("",)], "username string")
    filter_log_by_users(spark, str(tmp_path / "logs"), users, str(tmp_path / "out"))
    found = shards.read_shards(spark, [str(tmp_path / "out")], "file").collect()
    assert sorted((r.file, r.value) for r in found) == [("a_1log.gz", "x u1"), ("a_1log.gz", "é u2"), ("c_1log.gz", "u1")]


def test_log_is_sorted_by_user_and_time(lines):
    found = [json.loads(r.value) for r in sort_log(lines(*LOG)).collect()]
    keys = [r["username"] + " " + r["time"] for r in found]
    assert keys == sorted(keys) and len(keys) == 60 and all(isinstance(r["event"], dict) for r in found)


ROW_BY_ROW = {
    "parse": lambda df: parse_events(df),
    "repair": lambda df: repair_events(df),
    "decode": lambda df: decode_event_payload(parse_events(df)),
    "context": lambda df: remove_redundant_context(parse_events(df)),
    "truncate": lambda df: truncate_strings(parse_events(df), 2),
    "drop": lambda df: drop_fields(parse_events(df), ["ip"], ["session"]),
    "flatten": lambda df: flatten(parse_events(df), levels=4),
    "events": lambda df: filter_events(parse_events(df), ["a", "b"]),
    "courses": lambda df: filter_courses(parse_events(df), ["c1"]),
    "fields": lambda df: filter_fields(parse_events(df), {"username": ["u1", None]}),
    "date": lambda df: date_gt(parse_events(df), "2014-01-09"),
}


def test_operators_give_the_same_on_a_stream(spark, tmp_path):
    folder = _folder(tmp_path, "in", LOG)
    for name, change in ROW_BY_ROW.items():
        out, checkpoint = str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")
        ingest.incremental_ingest(spark, folder, out, checkpoint, change).awaitTermination()
        streamed = sorted(r[0] for r in spark.read.parquet(out).select(F.to_json("rec")).collect())
        batch = change(line_files.read_lines(spark, folder))
        assert streamed == sorted(r[0] for r in batch.select(F.to_json("rec")).collect()) and streamed, name


def test_text_operators_give_the_same_on_a_stream(spark, tmp_path):
    folder = _folder(tmp_path, "in", LOG)
    users = spark.createDataFrame([("u1",), ("u2",)], "username string")
    changes = {
        "select": lambda df: select_in(df, "u3"),
        "users": lambda df: filter_lines_by_users(df, users),
        "automaton": lambda df: filter_lines_by_users(df, users, automaton=True),
        "print": lambda df: json_select(parse_events(df), ["username", "time"], "value").select("value"),
        "project": lambda df: select_fields(parse_events(df), ["username"]).withColumnRenamed("username", "value"),
    }
    for name, change in changes.items():
        out = str(tmp_path / name)
        ingest.incremental_ingest(spark, folder, out, f"{out}-checkpoint", change).awaitTermination()
        streamed = sorted(r.value for r in spark.read.parquet(out).collect())
        assert streamed == sorted(r.value for r in change(line_files.read_lines(spark, folder)).collect()) and streamed, name


def test_a_stream_can_be_shown(spark, tmp_path):
    stream = line_files.read_lines(spark, _folder(tmp_path, "in", LOG), streaming=True)
    shown = ingest.show_stream(stream, 2)
    shown.awaitTermination()
    assert shown.exception() is None


def test_files_are_taken_once(spark, tmp_path):
    folder = _folder(tmp_path, "in", LOG)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for expected in (64, 64, 65):
        ingest.incremental_ingest(spark, folder, out, checkpoint).awaitTermination()
        if expected == 64:
            assert event_count(spark.read.parquet(out)).first()[0] == 64
            (tmp_path / "in" / "more.gz").write_bytes(gzip.compress(b"new\n")) if (tmp_path / "seen").exists() else (tmp_path / "seen").touch()
    assert event_count(spark.read.parquet(out)).first()[0] == 65


def test_a_repeated_batch_keeps_its_tokens(spark):
    table = scratch_path(spark, "tokens")
    write = ingest.token_writer(table, "user", "id")
    first = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "id bigint, user string")
    second = spark.createDataFrame([(4, "a"), (6, "d"), (5, "c")], "id bigint, user string")
    for number, batch in ((0, first), (1, second), (1, second)):
        write(batch, number)
    assert {r.user: r.token for r in ingest.read_tokens(spark, table).collect()} == {"a": "aaa", "b": "aab", "c": "aac", "d": "aad"}


def test_a_masked_batch_that_is_run_again_is_the_same(spark, lines):
    path = scratch_path(spark, "masked")
    write = ingest.masking_writer(f"{path}/tokens", f"{path}/out", "id")
    batches = [parse_events(lines(*LOG[:20])), parse_events(lines(*LOG)).where("id >= 20")]

    def state():
        rows = spark.read.parquet(f"{path}/out").select("id", field("username").alias("u"), F.to_json("rec").alias("r")).collect()
        return sorted(tuple(r) for r in rows), sorted(tuple(r) for r in ingest.read_tokens(spark, f"{path}/tokens").collect())

    write(batches[0], 0)
    write(batches[1], 1)
    once = state()
    # cut off after the tokens were written, and run again
    ingest.token_writer(f"{path}/tokens", F.to_json(F.col("rec")["username"]), "id")(batches[1], 1)
    write(batches[1], 1)
    assert state() == once and len(once[0]) == 60
    assert all(u is None or len(u) == 3 for _, u, _ in once[0])


def test_wide_tokens_of_a_stream_are_numbered_by_ranges(spark):
    table = scratch_path(spark, "tokens")
    write = ingest.token_writer(table, "user", "id", width=4)
    users = spark.range(3000).selectExpr("id", "concat('u', id % 1500) AS user")
    write(users.where("id < 1000"), 0)
    write(users.where("id >= 1000"), 1)
    found = {r.user: r.number for r in ingest.read_tokens(spark, table).collect()}
    assert found == {f"u{i}": i for i in range(1500)}


def test_running_distincts_equal_the_batch(spark, tmp_path):
    schema, folder = "username string, n int", str(tmp_path / "in")
    out = {}
    for part, rows in enumerate(([("a", 1), ("b", 2), (None, 3)], [("a", 4), ("a", 5)], [("c", 6), (None, 7)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        stream, batch = spark.readStream.schema(schema).parquet(folder), spark.read.parquet(folder)
        for missing in (True, False):
            counted = ingest.running_users(stream, include_missing=missing).writeStream.outputMode("complete")
            counted = counted.foreachBatch(lambda b, _, m=missing: out.__setitem__(m, b.first()[0]))
            counted.option("checkpointLocation", str(tmp_path / f"c{missing}")).trigger(availableNow=True).start().awaitTermination()
            assert out[missing] == users_count(batch, include_missing=missing).first()[0], part
        found = ingest.running_field_set(stream, "username").writeStream.format("parquet").option("path", str(tmp_path / "set"))
        found.option("checkpointLocation", str(tmp_path / "cs")).trigger(availableNow=True).start().awaitTermination()
        values = [r.username for r in spark.read.schema("username string").parquet(str(tmp_path / "set")).collect()]
        assert sorted(values, key=str) == sorted((r.username for r in field_set(batch, "username").collect()), key=str)


def test_probes_of_a_stream_are_summed(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), ingest.PassingRows()
    spark.streams.addListener(seen)
    for n in (3, 4):
        spark.range(n).write.mode("append").parquet(folder)
    stream, _ = item_count_probe(spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(folder), "rows-seen")
    run = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert seen.total(run, "rows-seen") == 7 and seen.total(run, "other") == 0
    spark.streams.removeListener(seen)
