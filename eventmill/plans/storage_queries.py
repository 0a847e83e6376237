"""Queries through files: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventmill.functions.paths import field
from eventmill.operators.counts import item_count_probe
from eventmill.operators.filters import low_income_codes as poor_codes
from eventmill.operators.ordering import number_rows
from eventmill.operators.parse import parse_events
from eventmill.plans.logs import clean_and_desensitize
from eventmill.plans.logs import filter_log_by_users as copy_lines_of_users
from eventmill.plans.record_queries import ASCII_EVENTS, EVENTS, LINES
from eventmill.plans.registry import query
from eventmill.plans.reports import save_reports
from eventmill.plans.table_queries import _user_views
from eventmill.plans.workload import EVENT_LINES, event_lines, table
from eventmill.session import scratch_path
from eventmill.sources import cached, files, lines, reference, shards
from eventmill.streaming import ingest


def _saved_lines(spark, sf_dir, label):
    path = scratch_path(spark, label)
    lines.save_events(event_lines(spark, sf_dir).select("value"), path)
    return path


@query("""SELECT regexp_replace(unnest(string_split(text, chr(10))), '[^\\x00-\\x7F]', '', 'g') AS value FROM documents""")
def read_lines(spark, sf_dir):
    path = scratch_path(spark, "texts")
    lines.save_events(table(spark, sf_dir, "documents").select(F.col("text").alias("value")), path)
    return lines.read_lines(spark, path, only_gz=True)


@query(f"{ASCII_EVENTS} SELECT j ->> '$.session' AS session, j ->> '$.event_type' AS event_type, (j ->> '$.amount')::BIGINT AS amount FROM ev")
def read_json_events(spark, sf_dir):
    events = lines.read_json_events(spark, _saved_lines(spark, sf_dir, "lines"))
    return events.select(
        field("session").alias("session"), field("event_type").alias("event_type"), field("amount", "bigint").alias("amount")
    )


@query("""SELECT n_nationkey::VARCHAR AS key, '"' || n_name || '"' AS name, n_regionkey::VARCHAR AS region, '' AS rest FROM nation""")
def read_delimited(spark, sf_dir):
    path = scratch_path(spark, "nations")
    line = F.concat_ws("\t", F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), "n_name", F.lit('"')), F.col("n_regionkey").cast("string"), F.lit(""))
    table(spark, sf_dir, "nation").select(line.alias("value")).write.text(path)
    fields = lines.read_delimited(spark, path)
    return fields.select(*[F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(("key", "name", "region", "rest"))])


@query(f"""{EVENTS} SELECT j ->> '$.username' AS username, j ->> '$.event_type' AS event_type, j ->> '$.event_source' AS event_source,
  j ->> '$.time' AS "time", j ->> '$.context.course_id' AS course_id, (j ->> '$.amount')::BIGINT AS amount FROM ev""")
def cache_events(spark, sf_dir):
    path = scratch_path(spark, "cache")
    cached.cache_events(parse_events(event_lines(spark, sf_dir).select("value")), path)
    return cached.read_cached_events(spark, path).select(*cached.HOT_PATHS, field("amount", "bigint").alias("amount"))


@query(f"{EVENTS} SELECT j ->> '$.session' AS session, j ->> '$.context.org' AS org FROM ev")
def dump_cached_as_json(spark, sf_dir):
    path = scratch_path(spark, "cache")
    cached.cache_events(parse_events(event_lines(spark, sf_dir).select("value")), path)
    cached.dump_cached_as_json(spark, path, f"{path}-json")
    dumped = lines.read_lines(spark, f"{path}-json")
    return dumped.select(F.get_json_object("value", "$.session").alias("session"), F.get_json_object("value", "$.context.org").alias("org"))


@query(f"{EVENTS} SELECT kind, count(*) AS events FROM ev GROUP BY kind")
def materialize_once(spark, sf_dir):
    path = scratch_path(spark, "once")
    events = parse_events(event_lines(spark, sf_dir))
    cached.materialize_once(events, path)
    # the second call reads what the first one wrote
    return cached.materialize_once(events.where(F.lit(False)), path).groupBy("kind").agg(F.count(F.lit(1)).alias("events"))


_FILES = "SELECT 'logs/' || source || '/' || doc_id AS path, n_chars AS length FROM documents"


def _listed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", F.lit("logs"), "source", "doc_id").alias("path"), F.col("n_chars").alias("length"))


@query(f"""WITH f AS ({_FILES}) SELECT path, length, row_number() OVER (ORDER BY path) - 1 AS position FROM f
  WHERE path LIKE '%7' AND path LIKE 'logs/%'""")
def file_manifest(spark, sf_dir):
    return number_rows(files.chosen_files(_listed(spark, sf_dir), suffix="7", prefix="logs/"))


@query(f"""WITH f AS ({_FILES}), g AS (SELECT split_part(path, '/', 3)[1] AS prefix, sum(length)::BIGINT AS bytes FROM f GROUP BY 1
  UNION ALL SELECT 'Total', sum(length)::BIGINT FROM f)
  SELECT prefix, bytes, bytes / 1e3 AS "kB", bytes / 1e6 AS "MB", bytes / 1e9 AS "GB", bytes / 1e12 AS "TB" FROM g""")
def path_sizes(spark, sf_dir):
    name = F.element_at(F.split("path", "/"), -1)
    return files.path_sizes(_listed(spark, sf_dir), F.substring(name, 1, 1))


@query(f"""WITH f AS ({_FILES}) SELECT split_part(path, '/', 2) AS prefix, sum(length)::BIGINT AS bytes FROM f GROUP BY 1
  UNION ALL SELECT 'Total', sum(length)::BIGINT FROM f""")
def sizes_by_source(spark, sf_dir):
    listed = table(spark, sf_dir, "documents").select(
        F.concat_ws("/", F.lit("logs"), "source", "doc_id").alias("path"), F.col("n_chars").alias("length"))
    return files.path_sizes(listed, F.split_part("path", F.lit("/"), F.lit(2))).select("prefix", "bytes")


def _written_texts(spark, sf_dir):
    """A folder per source and language with plain text files: as many bytes as the texts and their line ends have."""
    path = scratch_path(spark, "texts-by-source")
    docs = table(spark, sf_dir, "documents").select("source", "lang", F.coalesce("text", F.lit("")).alias("value"))
    docs.write.partitionBy("source", "lang").text(path)
    return path


@query("""SELECT 'source=' || source AS folder, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents
  WHERE lang = 'en' GROUP BY source""")
def list_written_files(spark, sf_dir):
    path = _written_texts(spark, sf_dir)
    found = files.file_manifest(spark, path, suffix=".txt").where(F.contains("path", F.lit("/lang=en/")))
    folder = F.element_at(F.split("path", "/"), -3)
    return found.groupBy(folder.alias("folder")).agg(F.sum("length").alias("bytes"))


@query("""WITH f AS (SELECT 'lang=' || lang AS prefix, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents GROUP BY lang)
SELECT prefix, bytes, bytes / 1e3 AS "kB" FROM (FROM f UNION ALL SELECT 'Total', sum(bytes)::BIGINT FROM f)""")
def sizes_of_written_files(spark, sf_dir):
    listed = files.file_manifest(spark, _written_texts(spark, sf_dir), suffix=".txt")
    return files.path_sizes(listed, F.element_at(F.split("path", "/"), -2)).select("prefix", "bytes", "kB")


@query(f"WITH f AS ({_FILES}) SELECT path, length, md5(path) AS id FROM f")
def incremental_manifest(spark, sf_dir):
    listed = table(spark, sf_dir, "documents").select(
        F.concat_ws("/", F.lit("logs"), "source", "doc_id").alias("path"), F.col("n_chars").alias("length"), "lang")
    store = scratch_path(spark, "manifest")
    files.incremental_manifest(listed.where("lang <> 'en'").drop("lang"), store)
    return files.incremental_manifest(listed.drop("lang"), store)


@query(f"WITH lines AS ({EVENT_LINES}) SELECT value, count(*) AS copies, true AS within_limit FROM lines GROUP BY value")
def save_events(spark, sf_dir):
    path = scratch_path(spark, "parts")
    lines.save_events(event_lines(spark, sf_dir).select("value"), path, most=1000)
    saved = lines.read_lines(spark, path, only_gz=True, ascii=False, file_column="file")
    sizes = saved.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return saved.join(sizes, "file").groupBy("value").agg(
        F.count(F.lit(1)).alias("copies"), (F.max("n") <= 1000).alias("within_limit"))


@query("SELECT event_id, event_type, user_id, value FROM events")
def write_json_lines(spark, sf_dir):
    path = scratch_path(spark, "json")
    lines.write_json_lines(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value"), path)
    return spark.read.schema("event_id bigint, event_type string, user_id bigint, value double").json(path)


@query(f"""{EVENTS} SELECT substr(md5(coalesce(j ->> '$.username', '___NONE___')), 1, 3) AS shard, count(*) AS lines FROM ev GROUP BY 1""")
def shard_by_user(spark, sf_dir):
    path = scratch_path(spark, "shards")
    shards.shard_by_user(parse_events(event_lines(spark, sf_dir)), path)
    return shards.read_shards(spark, [path]).groupBy("shard").agg(F.count(F.lit(1)).alias("lines"))


@query(f"""{EVENTS} SELECT j ->> '$.session' AS session, j ->> '$.username' AS username FROM ev
  WHERE substr(md5(coalesce(j ->> '$.username', '___NONE___')), 1, 3) = substr(md5('___NONE___'), 1, 3)""")
def read_shard(spark, sf_dir):
    events, path = parse_events(event_lines(spark, sf_dir)), scratch_path(spark, "runs")
    runs = [f"{path}/browser", f"{path}/server"]
    for run in runs:
        shards.shard_by_user(events.where(field("event_source") == run.rsplit("/", 1)[1]), run)
    name = spark.range(1).select(F.expr("substring(md5('___NONE___'), 1, 3)")).first()[0]
    found = shards.read_shard(spark, name, runs)
    return found.select(F.get_json_object("value", "$.session").alias("session"), F.get_json_object("value", "$.username").alias("username"))


@query("""SELECT (o_orderkey - 1) // 1000 AS chunk, o_custkey::VARCHAR AS customer, o_orderpriority AS priority FROM orders
  WHERE o_orderkey > 0 AND o_orderstatus = 'F'""")
def snapshot_by_id_range(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    finished = F.col("o_orderstatus") == "F"
    shards.snapshot_by_id_range(table(spark, sf_dir, "orders"), path, "o_orderkey", finished, ["o_custkey", "o_orderpriority"], 1000)
    saved = spark.read.schema("value string, chunk bigint").text(path)
    parts = F.split("value", "\t")
    return saved.select("chunk", F.get(parts, F.lit(0)).alias("customer"), F.get(parts, F.lit(1)).alias("priority"))


def _country_facts(spark, sf_dir, **options):
    """Nations as a facts file with odd headers, dollar amounts and quoted names, and a file of their languages."""
    path = scratch_path(spark, "facts")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    wealth = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("people"), F.max(F.floor("c_acctbal")).alias("most"))
    facts = nation.join(wealth, nation["n_nationkey"] == wealth["c_nationkey"]).select(
        F.concat("n_name", F.lit(', "the"')).alias("Country name"),
        F.concat(F.lit("$ "), F.col("most").cast("string")).alias("GDP - per capita (PPP)"),
        F.when(F.col("n_regionkey") > 0, F.concat(F.lit(".n"), F.col("n_nationkey").cast("string"))).alias("Internet country code"),
        F.col("people").cast("string").alias("Area"),
        F.concat(F.col("n_nationkey").cast("string"), F.lit(".5")).alias("Birth rate"),
        F.lit("café \x80" if "encoding" in options else "café €").alias("Background"),
    )
    writer = facts.write.option("header", True).option("quoteAll", False).option("escape", '"')
    # byte 80 is the euro sign in windows-1252
    writer.option("encoding", "ISO-8859-1" if "encoding" in options else "UTF-8").csv(f"{path}/facts")
    spoken = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.concat("n_name", F.lit(', "the"\t'), "r_name").alias("value"))
    spoken.write.text(f"{path}/languages")
    languages = reference.read_languages(spark, f"{path}/languages")
    return reference.load_reference_table(spark, f"{path}/facts", languages, excluded=['NATION_3, "the"'], view="country_facts", **options)


_FACTS = """facts AS (SELECT n_name || ', "the"' AS Country_name, max(floor(c_acctbal))::BIGINT AS GDP_per_capita_PPP,
  CASE WHEN n_regionkey > 0 THEN '.n' || n_nationkey ELSE '' END AS Internet_country_code, count(*) AS Area,
  n_nationkey + 0.5::DOUBLE AS Birth_rate, 'café €' AS Background, r_name AS language_list
  FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE n_name <> 'NATION_3' GROUP BY n_name, n_regionkey, n_nationkey, r_name)"""


@query(f"WITH {_FACTS} SELECT * FROM facts")
def load_reference_table(spark, sf_dir):
    return _country_facts(spark, sf_dir)


@query(f"WITH {_FACTS} SELECT substr(Internet_country_code, 2, 2) AS code FROM facts WHERE GDP_per_capita_PPP < 9990 AND Internet_country_code <> ''")
def low_income_codes(spark, sf_dir):
    return poor_codes(_country_facts(spark, sf_dir), 9990)


@query(f"WITH {_FACTS} SELECT Country_name, Area, Background, language_list FROM facts")
def publish_table(spark, sf_dir):
    facts = _country_facts(spark, sf_dir, encoding="windows-1252")
    reference.publish_table(facts, "published_facts", path=scratch_path(spark, "published"))
    return spark.table("published_facts").select("Country_name", "Area", "Background", "language_list")


@query("""SELECT 'some_users' AS report, username, id::VARCHAR AS number FROM (SELECT c_name AS username, c_custkey AS id FROM customer ORDER BY id LIMIT 10)
UNION ALL SELECT 'student_certs', c_name, count(DISTINCT o_orderkey)::VARCHAR FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_orderstatus = 'F' GROUP BY c_name, c_custkey""")
def save_named_reports(spark, sf_dir):
    _user_views(spark, sf_dir)
    _country_facts(spark, sf_dir)
    folder = scratch_path(spark, "reports")
    save_reports(spark, folder)
    read = spark.read.option("header", True).schema("username string, number string")
    saved = [read.csv(f"{folder}/{name}.csv").select(F.lit(name).alias("report"), "username", "number") for name in ("some_users", "student_certs")]
    return saved[0].unionByName(saved[1])


def _ingested(spark, sf_dir, change=None):
    """Two deliveries into one folder, one run after each, and a last run that finds nothing new."""
    path = scratch_path(spark, "stream")
    made = event_lines(spark, sf_dir)
    for kinds in (["click", "view"], ["error", "purchase", "signup"]):
        lines.save_events(made.where(F.col("kind").isin(kinds)).select("value"), f"{path}/in", mode="append")
        ingest.incremental_ingest(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", change).awaitTermination()
    ingest.incremental_ingest(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", change).awaitTermination()
    return f"{path}/out"


@query(f"{LINES} SELECT regexp_replace(value, '[^\\x00-\\x7F]', '', 'g') AS value FROM lines")
def incremental_ingest(spark, sf_dir):
    return spark.read.parquet(_ingested(spark, sf_dir))


@query(f"""{ASCII_EVENTS} SELECT j ->> '$.session' AS session, j ->> '$.context.org' AS org, j ->> '$.username' AS username FROM ev
  WHERE j ->> '$.event_source' = 'browser'""")
def streamed_records(spark, sf_dir):
    from eventmill.operators.clean import decode_event_payload, remove_redundant_context
    from eventmill.operators.filters import filter_fields

    def change(stream):
        cleaned = remove_redundant_context(decode_event_payload(parse_events(stream)))
        kept = filter_fields(cleaned, {"event_source": ["browser"]})
        return kept.select(field("session").alias("session"), field("context:org").alias("org"), field("username").alias("username"))

    return spark.read.parquet(_ingested(spark, sf_dir, change))


@query(f"{ASCII_EVENTS} SELECT j ->> '$.event_type' AS event_type, count(*) AS events FROM ev GROUP BY 1")
def streamed_counts(spark, sf_dir):
    out = scratch_path(spark, "counts")
    stream = parse_events(lines.read_lines(spark, _saved_lines(spark, sf_dir, "lines"), streaming=True))
    counted = ingest.running_counts(stream, "event_type").writeStream.outputMode("complete")
    written = counted.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/counts"))
    written.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/counts")


# the first batch brings browser events, the second the rest
@query("""WITH first AS (SELECT user_id, min(CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END) AS b FROM events GROUP BY user_id),
f AS (SELECT user_id, b, min(event_id) AS i FROM events JOIN first USING (user_id)
  WHERE (event_type IN ('click', 'view')) = (b = 0) GROUP BY user_id, b)
SELECT 'user' || user_id AS "user", row_number() OVER (ORDER BY b, i) - 1 AS number FROM f""")
def streamed_tokens(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit("user"), "user_id").alias("username"))
    write = ingest.token_writer(f"{path}/tokens", "username", "event_id")
    for kinds in (["click", "view"], ["error", "purchase", "signup"]):
        events.where(F.col("event_type").isin(kinds)).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        started = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
        started.trigger(availableNow=True).start().awaitTermination()
    return ingest.read_tokens(spark, f"{path}/tokens").select("user", "number")


def _named_gz(spark, folder):
    """Give the plain parts in a folder names that end in `.gz`."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files_ = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files_.listStatus(top):
        if status.getPath().getName().endswith(".txt"):
            files_.rename(status.getPath(), status.getPath().suffix(".gz"))


@query(f"{LINES} SELECT regexp_replace(value, '[^\\x00-\\x7F]', '', 'g') AS value FROM lines")
def ingest_misnamed_gzip(spark, sf_dir):
    """Gzip files, then plain text under such names, then nothing new."""
    path = scratch_path(spark, "misnamed")
    made = event_lines(spark, sf_dir)
    lines.save_events(made.where(F.col("kind").isin("click", "view")).select("value"), f"{path}/in/one")
    # a file named as gzip is one task's to read, so the plain ones are of limited length as well
    made.where(~F.col("kind").isin("click", "view")).select("value").write.option("maxRecordsPerFile", 20000).text(f"{path}/plain")
    _named_gz(spark, f"{path}/plain")
    for folder in (f"{path}/in", f"{path}/{{in,plain}}", f"{path}/{{in,plain}}"):
        ingest.incremental_ingest(spark, folder, f"{path}/out", f"{path}/checkpoint", only_gz=True).awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _deliveries(spark, sf_dir, label):
    """Three deliveries of event records as folders of a stream, each taken before the next one comes."""
    path = scratch_path(spark, label)
    made = event_lines(spark, sf_dir).select("event_id", "kind", "value")
    for kinds in (["click"], ["view", "error"], ["purchase", "signup"]):
        made.where(F.col("kind").isin(kinds)).write.mode("append").parquet(f"{path}/in")
        yield path, parse_events(spark.readStream.schema(made.schema).parquet(f"{path}/in"))


@query(f"{EVENTS} SELECT (count(DISTINCT j ->> '$.username') + max(((j ->> '$.username') IS NULL)::INT))::BIGINT AS users FROM ev")
def streamed_users_count(spark, sf_dir):
    for path, records in _deliveries(spark, sf_dir, "users"):
        counted = ingest.running_users(records).writeStream.outputMode("complete").option("checkpointLocation", f"{path}/checkpoint")
        written = counted.foreachBatch(lambda batch, _, path=path: batch.write.mode("overwrite").parquet(f"{path}/users"))
        written.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/users")


@query("""SELECT n AS delivery, count(*) AS passed FROM events, (VALUES (0, ['click']), (1, ['view', 'error']), (2, ['purchase', 'signup'])) v(n, kinds)
  WHERE list_contains(kinds, event_type) GROUP BY n""")
def streamed_count_probe(spark, sf_dir):
    """Rows that a probe saw in each run of a stream, reported while it ran."""
    events, seen, counts = table(spark, sf_dir, "events").select("event_id", "event_type"), ingest.PassingRows(), []
    path = scratch_path(spark, "probed")
    spark.streams.addListener(seen)
    for n, kinds in enumerate((["click"], ["view", "error"], ["purchase", "signup"])):
        events.where(F.col("event_type").isin(kinds)).write.mode("append").parquet(f"{path}/in")
        passing, _ = item_count_probe(spark.readStream.schema(events.schema).parquet(f"{path}/in"), "events")
        run = passing.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
        counts.append((n, seen.total(run.trigger(availableNow=True).start(), "events")))
    spark.streams.removeListener(seen)
    return spark.createDataFrame(counts, "delivery int, passed bigint")


@query(f"{EVENTS} SELECT DISTINCT j ->> '$.username' AS username FROM ev")
def streamed_field_set(spark, sf_dir):
    for path, records in _deliveries(spark, sf_dir, "values"):
        found = ingest.running_field_set(records, "username").writeStream.format("parquet").option("path", f"{path}/values")
        found.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/values")


@query(f"""{EVENTS}, named AS (SELECT event_id, j ->> '$.event_type' AS kind, j ->> '$.username' AS u FROM ev),
first AS (SELECT u, min(CASE kind WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 1 ELSE 2 END) AS b FROM named WHERE u IS NOT NULL GROUP BY u),
numbered AS (SELECT u, row_number() OVER (ORDER BY b, i, u) - 1 AS n FROM (SELECT u, b, min(event_id) AS i FROM named JOIN first USING (u)
  WHERE b = CASE kind WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 1 ELSE 2 END GROUP BY u, b)),
tokens AS (SELECT u, a[(n // 2704 % 52 + 1)::INT] || a[(n // 52 % 52 + 1)::INT] || a[(n % 52 + 1)::INT] AS token
  FROM numbered, (SELECT 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a))
SELECT event_id, kind AS event_type, token AS username, NULL::VARCHAR AS ip FROM named LEFT JOIN tokens USING (u)""")
def streamed_desensitize(spark, sf_dir):
    def shown(masked):
        return masked.select("event_id", field("event_type").alias("event_type"), field("username").alias("username"), field("ip").alias("ip"))

    for path, records in _deliveries(spark, sf_dir, "masked-stream"):
        taken = ingest.desensitize_stream(records.drop("kind"), f"{path}/tokens", f"{path}/out", f"{path}/checkpoint", "event_id", change=shown)
        taken.awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


@query(f"{EVENTS} SELECT event_id, j ->> '$.event_type' AS event_type FROM ev")
def desensitize_to_cache(spark, sf_dir):
    path = scratch_path(spark, "masked")
    masked = clean_and_desensitize(event_lines(spark, sf_dir), "event_id").select("event_id", "rec")
    cached.cache_events(masked, path)
    return cached.read_cached_events(spark, path).select("event_id", "event_type")


@query(f"""WITH lines AS ({EVENT_LINES}) SELECT value FROM lines l WHERE EXISTS
  (SELECT 1 FROM customer WHERE c_acctbal < 0 AND contains(l.value, 'user' || c_custkey))""")
def filter_log_by_users(spark, sf_dir):
    users = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("user"), "c_custkey").alias("username"))
    source = _saved_lines(spark, sf_dir, "lines")
    copy_lines_of_users(spark, source, users, f"{source}-found")
    return shards.read_shards(spark, [f"{source}-found"], "file").select("value")
