"""Activity-log inputs made from the driver tables by SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventmill.sources.lines import spread

# One JSON line per event. Some values of `k` give noise: arrays, text, cut lines, lines of a cut length, blanks,
# a letter outside ASCII before the line or in the name; some give events without a user or with a payload that is no JSON.
EVENT_LINES = """
SELECT event_id, event_type AS kind, user_id AS uid, k,
  CASE WHEN k = '7' THEN '["c", "d"]'
       WHEN k = '11' THEN 'not json ' || line
       WHEN k = '13' THEN substr(line, 1, length(line) - 3)
       WHEN k = '17' THEN '{"note": "' || repeat('x', 2041 - 12 - cast(length(line) AS int)) || '", ' || substr(line, 2)
       WHEN k = '19' THEN '  ' || line || ' '
       WHEN k = '23' THEN 'é' || line
       ELSE line END AS value
FROM (
  SELECT event_id, event_type, user_id, k,
    CASE WHEN k = '31' THEN '{' WHEN k = '37' THEN '{"username": "usér' || user_id || '", ' ELSE '{"username": "user' || user_id || '", ' END
    || '"event_type": "' || event_type
    || '", "event_source": "' || CASE WHEN event_type IN ('click', 'view') THEN 'browser' ELSE 'server' END
    || '", "time": "' || replace(cast(ts AS string), ' ', 'T')
    || '", "ip": "10.0.0.' || k || '", "agent": "Mozilla", "host": "h' || k || '", "session": "s' || event_id
    || '", "user_id": ' || user_id
    || ', "page": "http://h' || k || '/courses/Org' || k || '/x", "amount": ' || cast(round(value * 100) AS bigint)
    || ', "event": ' || CASE WHEN k = '29' THEN '"{cut"'
         WHEN event_type IN ('click', 'view') THEN '"' || replace(props, '"', chr(92) || '"') || '"'
         ELSE '{"k": ' || k || ', "session": "z", "csrfmiddlewaretoken": "t", "problem_id": "i4x:/p' || k || '/Org' || k || '"}' END
    || ', "context": {"ip": "10.0.0.' || k || '", "user_id": 0, "host": "h' || k
    || '", "course_user_tags": {}, "course_id": "course-v1:Org' || k || '+c+1T2024", "org": "Org' || k || '"}}' AS line
  FROM (SELECT *, substr(props, 7, length(props) - 7) AS k FROM events) e
) l
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`event_id, value` and the parts of the event the oracles speak of."""
    spread(table(spark, sf_dir, "events")).createOrReplaceTempView("_events")
    return spark.sql(EVENT_LINES.replace("FROM events", "FROM _events"))
