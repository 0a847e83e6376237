"""Queries over activity-log lines and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventmill.functions.events import event_date, source_institution
from eventmill.functions.json_text import as_text, record_text
from eventmill.functions.paths import field
from eventmill.operators.clean import decode_event_payload, remove_redundant_context, truncate_strings
from eventmill.operators.counts import event_count, field_set, item_count_probe, users_count
from eventmill.operators.filters import date_gt, filter_courses, filter_events, filter_fields, select_in
from eventmill.operators.joins import filter_events_by_users
from eventmill.operators.ordering import learner_traces as trace_order
from eventmill.operators.ordering import number_rows
from eventmill.operators.ordering import sort_events as order_events
from eventmill.operators.parse import CUT_LENGTHS, beyond_repair, parse_events as parse, repair_events as repair
from eventmill.operators.privacy import desensitize as mask
from eventmill.operators.privacy import tokenize_users as tokenize
from eventmill.operators.project import json_select as select_text
from eventmill.operators.project import json_select_lines as select_lines
from eventmill.operators.project import map_keep_truthy as keep_truthy
from eventmill.operators.project import select_fields as project
from eventmill.operators.shape import field_names as names_of
from eventmill.operators.shape import flatten as flat
from eventmill.operators.shape import schema_profile as profile
from eventmill.plans.logs import SENSITIVE_FIELDS, clean_and_desensitize, sort_log
from eventmill.plans.registry import query
from eventmill.plans.workload import EVENT_LINES, event_lines, table
from eventmill.session import scratch_path
from eventmill.sources.cached import cache_events, read_cached_events

LINES = f"""WITH lines AS ({EVENT_LINES}),
clean AS (SELECT event_id, kind, uid, k, trim(value) AS v FROM lines)"""
_KEPT = "v LIKE '{%' AND json_valid(v)"
EVENTS = f"""{LINES},
ev AS (SELECT event_id, kind, uid, k, try_cast(v AS JSON) AS j FROM clean WHERE {_KEPT})"""
# the same after a reader that drops what is not ASCII
ASCII_EVENTS = EVENTS.replace("trim(value)", "trim(regexp_replace(value, '[^\\x00-\\x7F]', '', 'g'))")
# payload decoded: text that is JSON is parsed, other text is marked
DECODED = f"""{EVENTS},
dec AS (SELECT *, CASE WHEN json_type(j, '$.event') = 'VARCHAR'
    THEN CASE WHEN json_valid(j ->> '$.event') THEN try_cast(j ->> '$.event' AS JSON) ELSE '"Truncated"'::JSON END
    ELSE json_extract(j, '$.event') END AS e FROM ev)"""


@query(f"""{EVENTS} SELECT event_id, j ->> '$.username' AS username, j ->> '$.event_type' AS event_type,
  (j ->> '$.amount')::BIGINT AS amount, j ->> '$.context.course_id' AS course_id FROM ev""")
def parse_events(spark, sf_dir):
    return parse(event_lines(spark, sf_dir)).select(
        "event_id", field("username").alias("username"), field("event_type").alias("event_type"),
        field("amount", "bigint").alias("amount"), field("context:course_id").alias("course_id"),
    )


# cut lines lack three characters, which one ending puts back; no line is dropped for its length
@query(f"""{LINES}, whole AS (SELECT event_id, CASE WHEN json_valid(v) THEN v ELSE v || '"}}}}' END AS w FROM clean WHERE v LIKE '{{%')
SELECT event_id, try_cast(w AS JSON) ->> '$.event_type' AS event_type, try_cast(w AS JSON) ->> '$.context.org' AS org FROM whole""")
def repair_events(spark, sf_dir):
    return repair(event_lines(spark, sf_dir)).select(
        "event_id", field("event_type").alias("event_type"), field("context:org").alias("org")
    )


# text after the closing brace cannot be repaired, unless it continues a string that was cut
@query(f"""{LINES} SELECT event_id, v || 'xyz' AS value FROM clean WHERE kind = 'error' AND v LIKE '{{%' AND k <> '13'""")
def beyond_repair_events(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    stripped = F.rtrim("value")
    spoilt = lines.withColumn("value", F.when(F.col("kind") == "error", F.concat(stripped, F.lit("xyz"))).otherwise(F.col("value")))
    return beyond_repair(spoilt).select("event_id", "value")


# the option that drops lines of the lengths at which loggers cut, whole ones too
@query(f"""{EVENTS} SELECT event_id, j ->> '$.username' AS username FROM ev JOIN clean USING (event_id)
  WHERE length(v) NOT BETWEEN 2039 AND 2043 AND length(v) NOT BETWEEN 9980 AND 10000 AND length(v) NOT BETWEEN 32000 AND 32999""")
def parse_events_of_uncut_lengths(spark, sf_dir):
    return parse(event_lines(spark, sf_dir), cut_lengths=CUT_LENGTHS).select("event_id", field("username").alias("username"))


@query(f"{EVENTS} SELECT event_id, j ->> '$.context.course_id' AS course_id, j ->> '$.context.nothing' AS nothing FROM ev")
def select_field(spark, sf_dir):
    return parse(event_lines(spark, sf_dir)).select(
        "event_id", field("context:course_id").alias("course_id"), field("context:nothing").alias("nothing")
    )


@query(f"""{EVENTS} SELECT j ->> '$.username' AS username, j ->> '$.time' AS "time",
  CASE WHEN json_type(j, '$.event') = 'OBJECT' THEN (j ->> '$.event.k')::BIGINT END AS "event:k" FROM ev""")
def select_fields(spark, sf_dir):
    return project(parse(event_lines(spark, sf_dir)), ["username", "time", "event:k"], {"event:k": "bigint"})


@query(f"""{EVENTS} SELECT event_id, concat_ws(' ', j ->> '$.username', j ->> '$.amount', j ->> '$.event_type') AS text FROM ev""")
def json_select(spark, sf_dir):
    return select_text(parse(event_lines(spark, sf_dir)), ["username", "amount", "missing", "event_type"]).select(
        "event_id", "text"
    )


_LEAVES = f"""{DECODED},
paths AS (
  SELECT event_id, key AS path, json_extract(j, '$.' || key) AS v FROM (SELECT *, unnest(json_keys(j)) AS key FROM dec)
   WHERE key NOT IN ('event', 'context')
  UNION ALL SELECT event_id, 'context.' || key, json_extract(j, '$.context.' || key)
   FROM (SELECT *, unnest(json_keys(j, '$.context')) AS key FROM dec) WHERE key <> 'course_user_tags'
  UNION ALL SELECT event_id, 'event.' || key, json_extract(e, '$.' || key)
   FROM (SELECT *, unnest(json_keys(e)) AS key FROM dec WHERE json_type(e) = 'OBJECT')
  UNION ALL SELECT event_id, 'event', e FROM dec WHERE json_type(e) <> 'OBJECT')"""


@query(f"{_LEAVES} SELECT DISTINCT path FROM paths")
def field_names(spark, sf_dir):
    return names_of(decode_event_payload(parse(event_lines(spark, sf_dir))))


@query(f"{_LEAVES} SELECT event_id, path, v ->> '$' AS value FROM paths")
def flatten(spark, sf_dir):
    records = flat(decode_event_payload(parse(event_lines(spark, sf_dir))))
    return records.select("event_id", F.explode("rec").alias("path", "value")).select(
        "event_id", "path", F.try_variant_get("value", "$", "string").alias("value")
    )


@query(f"""{_LEAVES} SELECT path, count(*) AS records, arg_max(v ->> '$', event_id) AS example FROM paths
  WHERE path NOT LIKE '%correct\\_map.%' ESCAPE '\\' AND path NOT LIKE '%submission%' AND path NOT LIKE '%answers%'
  AND path NOT LIKE '%POST%' GROUP BY path""")
def schema_profile(spark, sf_dir):
    profiled = profile(parse(event_lines(spark, sf_dir)), "event_id")
    return profiled.select("path", "records", F.regexp_replace("example", '^"|"$', "").alias("example"))


_TYPED = """SELECT doc_id, '{"id": ' || doc_id || ', "v": ' || CASE doc_id % 6 WHEN 0 THEN cast(n_chars AS string) WHEN 1 THEN '"x"' WHEN 2 THEN 'null'
  WHEN 3 THEN '[1, "a"]' WHEN 4 THEN '{"deep": {"b": true, "none": {}}}' ELSE '1.5' END || '}' AS value FROM documents"""


@query("""SELECT path, count(*) AS records, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types FROM (
  SELECT 'id' AS path, 'number' AS kind FROM documents UNION ALL SELECT 'v.deep.b', 'boolean' FROM documents WHERE doc_id % 6 = 4
  UNION ALL SELECT 'v', ['number', 'string', 'null', 'array', '', 'number'][doc_id % 6 + 1] FROM documents WHERE doc_id % 6 <> 4) GROUP BY path""")
def schema_types(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("_documents")
    return profile(parse(spark.sql(_TYPED.replace("FROM documents", "FROM _documents"))), "doc_id").select("path", "records", "types")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' ELSE lang || ' ' || n_chars END AS value FROM documents WHERE doc_id % 3 <> 2""")
def json_select_lines(spark, sf_dir):
    line = F.when(F.col("doc_id") % 3 == 0, "{}").when(F.col("doc_id") % 3 == 1, F.to_json(F.struct("n_chars", "lang"))).otherwise("no json")
    return select_lines(table(spark, sf_dir, "documents").select("doc_id", line.alias("value")), ["lang", "n_chars", "missing"])


@query(f"""{DECODED} SELECT event_id, CASE WHEN json_type(e) = 'OBJECT' THEN (e ->> '$.k')::BIGINT END AS k,
  CASE WHEN json_type(e) <> 'OBJECT' THEN e ->> '$' END AS mark FROM dec""")
def decode_payload(spark, sf_dir):
    return decode_event_payload(parse(event_lines(spark, sf_dir))).select(
        "event_id", field("event:k", "bigint").alias("k"), as_text(F.col("rec")["event"]).alias("mark")
    )


@query(f"""{EVENTS} SELECT event_id, j ->> '$.ip' AS ip, j ->> '$.context.org' AS org,
  CASE WHEN (j -> '$.context.ip')::VARCHAR <> (j -> '$.ip')::VARCHAR THEN j ->> '$.context.ip' END AS context_ip,
  CASE WHEN (j -> '$.context.user_id')::VARCHAR <> (j -> '$.user_id')::VARCHAR THEN (j ->> '$.context.user_id')::BIGINT END AS context_user,
  false AS tags FROM ev""")
def remove_context(spark, sf_dir):
    tags = F.contains(record_text(F.col("rec")["context"]), F.lit("course_user_tags"))
    return remove_redundant_context(parse(event_lines(spark, sf_dir))).select(
        "event_id", field("ip").alias("ip"), field("context:org").alias("org"), field("context:ip").alias("context_ip"),
        field("context:user_id", "bigint").alias("context_user"), tags.alias("tags"),
    )


@query(f"""{EVENTS} SELECT event_id, CASE WHEN length(j ->> '$.username') <= 6 THEN j ->> '$.username' END AS username,
  CASE WHEN length(j ->> '$.event_type') <= 6 THEN j ->> '$.event_type' END AS event_type,
  (j ->> '$.amount')::BIGINT AS amount, CASE WHEN length(j ->> '$.context.org') <= 6 THEN j ->> '$.context.org' END AS org,
  CASE WHEN length(j ->> '$.context.course_id') <= 6 THEN j ->> '$.context.course_id' END AS course_id FROM ev""")
def truncate_records(spark, sf_dir):
    return truncate_strings(parse(event_lines(spark, sf_dir)), 6).select(
        "event_id", field("username").alias("username"), field("event_type").alias("event_type"),
        field("amount", "bigint").alias("amount"), field("context:org").alias("org"),
        field("context:course_id").alias("course_id"),
    )


_TOKENS = """first AS (SELECT u, min(event_id) AS f FROM named WHERE u IS NOT NULL GROUP BY u),
tokens AS (SELECT u, row_number() OVER (ORDER BY f, u) - 1 AS n FROM first),
coded AS (SELECT u, substr(a, (n // 2704 % 52 + 1)::INT, 1) || substr(a, (n // 52 % 52 + 1)::INT, 1) || substr(a, (n % 52 + 1)::INT, 1) AS t
  FROM tokens, (SELECT 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a))"""


@query(f"""{EVENTS}, named AS (SELECT event_id, j, j ->> '$.username' AS u FROM ev), {_TOKENS}
SELECT event_id, t AS username, j ->> '$.agent' AS agent, CAST(NULL AS VARCHAR) AS ip, CAST(NULL AS VARCHAR) AS context_ip,
  CASE WHEN json_type(j, '$.event') = 'OBJECT' THEN j ->> '$.event.session' END AS event_session, CAST(NULL AS VARCHAR) AS event_csrf
FROM named LEFT JOIN coded USING (u)""")
def desensitize(spark, sf_dir):
    masked = mask(parse(event_lines(spark, sf_dir)), ["ip", "host"], ["csrfmiddlewaretoken"], "event_id")
    return masked.select(
        "event_id", field("username").alias("username"), field("agent").alias("agent"), field("ip").alias("ip"),
        field("context:ip").alias("context_ip"), field("event:session").alias("event_session"),
        field("event:csrfmiddlewaretoken").alias("event_csrf"),
    )


@query(f"""{DECODED}, named AS (SELECT *, j ->> '$.username' AS u FROM dec WHERE (j ->> '$.time')::TIMESTAMP > TIMESTAMP '2024-01-10 00:00:00'), {_TOKENS}
SELECT event_id, t AS username, j ->> '$.event_type' AS event_type, CASE WHEN json_type(e) = 'OBJECT' THEN (e ->> '$.k')::BIGINT END AS k,
  CAST(NULL AS VARCHAR) AS session, CAST(NULL AS VARCHAR) AS agent, CAST(NULL AS VARCHAR) AS event_session, j ->> '$.context.org' AS org
FROM named LEFT JOIN coded USING (u)""")
def desensitize_log(spark, sf_dir):
    return clean_and_desensitize(event_lines(spark, sf_dir), "event_id", "2024-01-10").select(
        "event_id", field("username").alias("username"), field("event_type").alias("event_type"),
        field("event:k", "bigint").alias("k"), field("session").alias("session"), field("agent").alias("agent"),
        field("event:session").alias("event_session"), field("context:org").alias("org"),
    )


@query(f"""{EVENTS}, named AS (SELECT event_id, j, j ->> '$.username' AS u FROM ev), {_TOKENS}
SELECT event_id, t AS username, t AS in_record, j ->> '$.event_type' AS event_type, 0 AS left_over FROM named LEFT JOIN coded USING (u)""")
def desensitize_cached(spark, sf_dir):
    """A cache, masked, and cached again: names are gone from plain columns too."""
    path = scratch_path(spark, "cache")
    cache_events(parse(event_lines(spark, sf_dir).select("event_id", "value")), path)
    cached = read_cached_events(spark, path).withColumn("ip", field("ip"))
    cache_events(clean_and_desensitize(cached, "event_id"), f"{path}-masked")
    again = read_cached_events(spark, f"{path}-masked")
    plain = [F.lit(int(name in SENSITIVE_FIELDS)) for name in again.columns]
    keys = F.map_keys("rec")
    left = sum([F.array_contains(keys, name).cast("int") for name in SENSITIVE_FIELDS], sum(plain, F.lit(0)))
    return again.select(
        "event_id", "username", field("username").alias("in_record"), "event_type", left.alias("left_over")
    )


@query(f"""WITH named AS (SELECT event_id, event_type, 'user' || user_id AS u FROM events), {_TOKENS}
SELECT event_id, event_type, t AS username FROM named JOIN coded USING (u)""")
def tokenize_users(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    named = events.select("event_id", "event_type", F.concat(F.lit("user"), "user_id").alias("username"))
    return tokenize(named, "username", "event_id")


@query(f"""{EVENTS} SELECT event_id, CASE WHEN kind IN ('click', 'view') THEN 'Org' || k
  WHEN kind = 'signup' THEN 'Org' || k WHEN kind = 'error' THEN 'Global'
  WHEN k = '29' THEN 'Unhandled' ELSE 'Org' || k END AS institution FROM ev""")
def source_institution_of_event(spark, sf_dir):
    events = parse(event_lines(spark, sf_dir))
    # sign-ups happen in a course, errors outside; other server events name a problem
    kind = (
        F.when(F.col("kind") == "signup", F.concat(F.lit("/courses/Org"), "k", F.lit("/about")))
        .when(F.col("kind") == "error", "/dashboard")
        .otherwise(field("event_type"))
    )
    institution = source_institution(field("event_source"), kind, field("page"), field("event:problem_id"))
    return events.select("event_id", institution.alias("institution"))


@query("""SELECT page_id, CASE WHEN contains(url, 'courses') THEN string_split(url, '/')[5] ELSE 'BGE' END AS plain,
  string_split(replace(url, '.example.', '.courses.'), '/')[5] AS in_course FROM pages""")
def source_institution_of_page(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    browser, nothing = F.lit("browser"), F.lit(None).cast("string")
    moved = F.replace("url", F.lit(".example."), F.lit(".courses."))
    return pages.select(
        "page_id", source_institution(browser, nothing, F.col("url"), nothing).alias("plain"),
        source_institution(browser, nothing, moved, nothing).alias("in_course"),
    )


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, 'XX' AS none FROM events")
def event_day(spark, sf_dir):
    time = F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T"))
    return table(spark, sf_dir, "events").select(
        "event_id", event_date(time).alias("day"), event_date(F.lit(None).cast("string")).alias("none")
    )


@query("SELECT event_id, nullif(round(value) - 3, 0) AS step FROM events WHERE round(value) <> 3")
def map_keep_truthy(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return keep_truthy(events, F.round("value") - 3, "step").select("event_id", "step")


@query(f"""WITH lines AS ({EVENT_LINES}) SELECT event_id, value FROM lines WHERE contains(value, '"purchase"')""")
def select_in_lines(spark, sf_dir):
    return select_in(event_lines(spark, sf_dir), '"purchase"').select("event_id", "value")


@query("SELECT doc_id, lang FROM documents WHERE contains(text, 'the ')")
def select_in_documents(spark, sf_dir):
    return select_in(table(spark, sf_dir, "documents"), "the ", "text").select("doc_id", "lang")


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def date_gt_typed(spark, sf_dir):
    return date_gt(table(spark, sf_dir, "events"), "Jan 15 2024", "ts").select("event_id", "ts")


@query(f"{EVENTS} SELECT event_id FROM ev WHERE (j ->> '$.time')::TIMESTAMP > TIMESTAMP '2024-01-20 12:00:00'")
def date_gt_records(spark, sf_dir):
    return date_gt(parse(event_lines(spark, sf_dir)), "2024-01-20T12:00").select("event_id")


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'purchase')")
def filter_events_typed(spark, sf_dir):
    return filter_events(table(spark, sf_dir, "events"), ["click", "purchase"]).select("event_id", "user_id")


@query(f"{EVENTS} SELECT event_id FROM ev WHERE j ->> '$.event_type' IN ('click', 'purchase')")
def filter_events_records(spark, sf_dir):
    return filter_events(parse(event_lines(spark, sf_dir)), ["click", "purchase"]).select("event_id")


@query(f"{EVENTS} SELECT event_id FROM ev WHERE j ->> '$.context.course_id' IN ('course-v1:Org3+c+1T2024', 'course-v1:Org40+c+1T2024')")
def filter_courses_records(spark, sf_dir):
    courses = ["course-v1:Org3+c+1T2024", "course-v1:Org40+c+1T2024"]
    return filter_courses(parse(event_lines(spark, sf_dir)), courses).select("event_id")


@query(f"""{EVENTS} SELECT event_id FROM ev WHERE (j ->> '$.username' IN ('user1', 'user2') OR j ->> '$.username' IS NULL)
  AND j ->> '$.event_source' = 'browser'""")
def filter_fields_records(spark, sf_dir):
    spec = {"username": ["user1", "user2", None], "event_source": ["browser"]}
    return filter_fields(parse(event_lines(spark, sf_dir)), spec).select("event_id")


@query(f"""{EVENTS} SELECT event_id FROM ev WHERE j ->> '$.username' IN (SELECT 'user' || c_custkey FROM customer WHERE c_acctbal < 0)""")
def filter_events_by_listed_users(spark, sf_dir):
    users = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit(" user"), "c_custkey").alias("username"))
    return filter_events_by_users(parse(event_lines(spark, sf_dir)), users).select("event_id")


@query(f"{EVENTS} SELECT count(*) AS events FROM ev")
def count_events(spark, sf_dir):
    return event_count(parse(event_lines(spark, sf_dir)))


@query(f"{EVENTS} SELECT count(DISTINCT j ->> '$.username') + max(CASE WHEN j ->> '$.username' IS NULL THEN 1 ELSE 0 END) AS users FROM ev")
def count_users(spark, sf_dir):
    return users_count(parse(event_lines(spark, sf_dir)))


@query(f"{EVENTS} SELECT DISTINCT j ->> '$.username' AS username FROM ev")
def distinct_values(spark, sf_dir):
    return field_set(parse(event_lines(spark, sf_dir)), "username")


@query("SELECT event_type, count(*) AS events, (SELECT count(*) FROM events) AS passed FROM events GROUP BY event_type")
def count_while_passing(spark, sf_dir):
    """One run gives both the result and the number of rows that went into it."""
    passing, observation = item_count_probe(table(spark, sf_dir, "events"), "events")
    path = scratch_path(spark, "counted")
    passing.groupBy("event_type").agg(F.count(F.lit(1)).alias("events")).write.parquet(path)
    return spark.read.parquet(path).withColumn("passed", F.lit(observation.get["rows"]).cast("bigint"))


@query(f"""{EVENTS} SELECT event_id, row_number() OVER (ORDER BY j ->> '$.username' NULLS FIRST, j ->> '$.time', event_id) - 1 AS position FROM ev""")
def sort_events(spark, sf_dir):
    events = project_with_id(parse(event_lines(spark, sf_dir)))
    return number_rows(order_events(events, ["username", "time", "event_id"])).select("event_id", "position")


def project_with_id(records):
    return records.select("event_id", field("username").alias("username"), field("time").alias("time"))


@query(f"{EVENTS} SELECT j ->> '$.username' AS username, j ->> '$.time' AS \"time\", j ->> '$.session' AS session FROM ev")
def sorted_log_lines(spark, sf_dir):
    names = ("username", "time", "session")
    return sort_log(event_lines(spark, sf_dir)).select(F.json_tuple("value", *names).alias(*names))


@query(f"""{EVENTS}, sorted AS (SELECT event_id, j, row_number() OVER (ORDER BY coalesce(j ->> '$.username', '') || ' ' || (j ->> '$.time')) - 1 AS position FROM ev)
SELECT position, j ->> '$.username' AS username, j ->> '$.time' AS "time" FROM sorted""")
def sort_log_by_user_time(spark, sf_dir):
    lines = sort_log(event_lines(spark, sf_dir))
    return number_rows(lines).select(
        "position", F.get_json_object("value", "$.username").alias("username"), F.get_json_object("value", "$.time").alias("time")
    )


@query(f"""{EVENTS} SELECT event_id, j ->> '$.username' AS username, row_number() OVER (ORDER BY j ->> '$.username' NULLS FIRST, j ->> '$.time', event_id) - 1 AS position FROM ev""")
def learner_traces(spark, sf_dir):
    events = project_with_id(parse(event_lines(spark, sf_dir)))
    traced = trace_order(events, ordinal="event_id")
    return number_rows(traced).select("event_id", "username", "position")
