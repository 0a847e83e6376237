"""Queries over typed tables, texts and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from eventmill.functions.courses import canonical_course
from eventmill.functions.identity import all_short_hashes as shard_names
from eventmill.functions.identity import short_hash as hash_prefix
from eventmill.functions.plain_text import ascii_fold as fold
from eventmill.functions.plain_text import visible_text as text_of
from eventmill.functions.typed import clean_name, parse_dollars, parse_float, parse_int
from eventmill.operators.clean import truncate_strings
from eventmill.operators.counts import count_distinct_by_key as distinct_by_key
from eventmill.operators.counts import proportion_bounds as bounds
from eventmill.operators.filters import exclude_list as without
from eventmill.operators.filters import filter_data as where
from eventmill.operators.joins import filter_lines_by_users as lines_by_users
from eventmill.operators.joins import lookup_join as lookup
from eventmill.operators.ordering import big_sort as sort_big
from eventmill.operators.ordering import merge_sorted as merge
from eventmill.operators.ordering import number_rows
from eventmill.operators.ordering import peek as first_rows
from eventmill.operators.pages import pages_to_text as to_text
from eventmill.operators.tables import clean_column_names as clean_names
from eventmill.plans.page_oracle import page_text_sql
from eventmill.plans.registry import query
from eventmill.plans.reports import run_report
from eventmill.plans.resources import export_resources as export
from eventmill.plans.resources import problems_to_text as to_ascii_text
from eventmill.plans.workload import table
from eventmill.sources.lines import spread


@query("SELECT doc_id, CASE WHEN length(text) <= 500 THEN text END AS text, lang FROM documents")
def truncate_documents(spark, sf_dir):
    return truncate_strings(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), 500)


@query("SELECT conv_id, turn, CASE WHEN length(text) <= 500 THEN text END AS text FROM conversations")
def truncate_conversations(spark, sf_dir):
    return truncate_strings(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), 500)


@query("SELECT c_custkey, substr(md5(c_name), 1, 3) AS shard FROM customer")
def short_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", hash_prefix(F.col("c_name")).alias("shard"))


@query("""SELECT s.shard, count(c_custkey) AS customers
FROM (SELECT lower(lpad(to_hex(i), 3, '0')) AS shard FROM range(4096) r(i)) s
LEFT JOIN customer ON substr(md5(c_name), 1, 3) = s.shard GROUP BY s.shard""")
def all_short_hashes(spark, sf_dir):
    # counted first: what is joined has one row per shard
    counted = table(spark, sf_dir, "customer").groupBy(hash_prefix(F.col("c_name")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return shard_names(spark).join(counted, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).cast("bigint").alias("customers"))


# ids in several spellings of one run, made from customer keys
_COURSE = """CASE {key} % 6 WHEN 0 THEN 'course-v1:Org' || {key} || '+C1+1T2016' WHEN 1 THEN 'Org' || {key} || '/C1/2015Q1'
  WHEN 2 THEN 'i4x://Org' || {key} || '/C1/2015_Q3' WHEN 3 THEN 'ccx-v1:Org' || {key} || '+C1+T12016@ccx'
  WHEN 4 THEN 'Org' || {key} || '/C1/X' ELSE 'Org' || {key} END"""


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Org' || c_custkey || '/C1/2016T1' WHEN 1 THEN 'Org' || c_custkey || '/C1/2015T1'
  WHEN 2 THEN 'Org' || c_custkey || '/C1/2015T3' WHEN 3 THEN 'Org' || c_custkey || '/C1/2016T1'
  WHEN 4 THEN 'Org' || c_custkey || '/C1/2016' ELSE 'Org' || c_custkey END AS course FROM customer""")
def canonical_course_id(spark, sf_dir):
    spelled = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_COURSE.format(key="c_custkey")).alias("course"))
    return spelled.select("c_custkey", canonical_course(F.col("course")).alias("course"))


@query("SELECT p_partkey AS part_key, p_type || ' (' || p_brand || ')' AS type_and_brand FROM part")
def clean_column_names(spark, sf_dir):
    both = F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))
    return clean_names(table(spark, sf_dir, "part").select(F.col("p_partkey").alias(" part-key "), both.alias("type & (and)  brand?")))


@query("""SELECT p_partkey, trim(regexp_replace(' ' || p_type || ' - (' || p_brand || ')', '[^A-Za-z0-9]+', '_', 'g'), '_') AS name FROM part""")
def clean_names_in_column(spark, sf_dir):
    text = F.concat(F.lit(" "), "p_type", F.lit(" - ("), "p_brand", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", clean_name(text).alias("name"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey AS whole, l_discount AS floating, l_suppkey * 1000 AS dollars,
  CAST(NULL AS BIGINT) AS nothing FROM lineitem""")
def parse_typed_column(spark, sf_dir):
    text = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("whole"),
        F.col("l_discount").cast("string").alias("floating"),
        F.concat(F.lit("$ "), F.col("l_suppkey").cast("string"), F.lit(" 000")).alias("dollars"),
    )
    return text.select(
        "l_orderkey", "l_linenumber", parse_int(F.col("whole")).alias("whole"), parse_float(F.col("floating")).alias("floating"),
        parse_dollars(F.col("dollars")).alias("dollars"), parse_int(F.lit("")).alias("nothing"),
    )


# the same text with the folding written out
_ACCENTS = [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("©", "(C)"), ("—", "--"), ("–", "-"), ("’", "'"), ("…", "...")]
_FOLDED = reduce(lambda sql, pair: f"replace({sql}, '{pair[0]}', '{pair[1].replace(chr(39), chr(39) * 2)}')", _ACCENTS, "text")


@query(f"SELECT doc_id, regexp_replace(strip_accents({_FOLDED}), '[^\\x00-\\x7F]', '', 'g') AS text FROM documents")
def ascii_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fold(F.col("text")).alias("text"))


_TAGLESS = r"regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[^>]*>', ' ', 'g')"
_ENTITIES = [("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&middot;", "*"), ("&copy;", "(C)"), ("&nbsp;", " "), ("&amp;", "&")]
_PLAIN = reduce(lambda sql, pair: f"replace({sql}, '{pair[0]}', '{pair[1]}')", _ENTITIES, _TAGLESS)


@query(f"SELECT page_id, trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g')) AS text FROM pages")
def visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text_of(F.col("html")).alias("text"))


@query(page_text_sql())
def pages_to_text(spark, sf_dir):
    return to_text(table(spark, sf_dir, "pages"), "page_id", "html")


@query(page_text_sql(base="http://example.org"))
def pages_to_text_with_references(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("at", F.lit("http://example.org/a/b.html"))
    return to_text(pages, "page_id", "html", inline_links=False, base=F.col("at"))


@query(page_text_sql(f"regexp_replace(strip_accents({_FOLDED.replace('text', 'html')}), '[^\\x00-\\x7F]', '', 'g')"))
def problems_to_text(spark, sf_dir):
    return to_ascii_text(table(spark, sf_dir, "pages"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05")
def filter_data(spark, sf_dir):
    rows = where(table(spark, sf_dir, "lineitem"), (F.col("l_quantity") < 24) & (F.col("l_discount") >= 0.05))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN ('NATION_3', 'NATION_7', 'Antarctica')")
def exclude_list(spark, sf_dir):
    return without(table(spark, sf_dir, "nation"), "n_name", ["NATION_3", "NATION_7", "Antarctica"]).select("n_nationkey", "n_name")


_MENTIONS = """SELECT doc_id, lang FROM documents d WHERE EXISTS
  (SELECT 1 FROM (SELECT DISTINCT string_split(text, ' ')[2] AS word FROM conversations) w
   WHERE length(word) >= 6 AND contains(d.text, word))"""


def _mentioning(spark, sf_dir, **how):
    words = table(spark, sf_dir, "conversations").select(F.get(F.split("text", " "), F.lit(1)).alias("username"))
    users = words.where(F.length("username") >= 6)
    return lines_by_users(spread(table(spark, sf_dir, "documents")), users, "text", **how).select("doc_id", "lang")


@query(_MENTIONS)
def filter_lines_by_users(spark, sf_dir):
    return _mentioning(spark, sf_dir)


@query(_MENTIONS)
def filter_lines_by_joined_users(spark, sf_dir):
    return _mentioning(spark, sf_dir, few=0)


@query(_MENTIONS)
def filter_lines_by_automaton(spark, sf_dir):
    return _mentioning(spark, sf_dir, automaton=True)


@query("SELECT n_name, r_regionkey::BIGINT AS n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("key"), "r_name")
    nation = table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("key"))
    return lookup(nation, region, "key", "r_name").select("n_name", F.col("key").cast("bigint").alias("n_regionkey"), "r_name")


def _user_views(spark, sf_dir):
    table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS user_id", "CASE o_orderstatus WHEN 'F' THEN 'downloadable' ELSE 'unavailable' END AS status"
    ).createOrReplaceTempView("certificates")
    customer = table(spark, sf_dir, "customer")
    customer.selectExpr(
        "c_custkey AS id", "c_name AS username", "date '2013-01-01' AS date_joined",
        "concat(c_name, '@example.org') AS email", "c_acctbal > 0 AS is_active",
    ).createOrReplaceTempView("auth_user")
    customer.selectExpr(
        "c_custkey AS user_id", "1950 + c_nationkey AS year_of_birth", "c_mktsegment AS gender",
        "c_nationkey AS level_of_education",
    ).createOrReplaceTempView("auth_userprofile")


@query("""SELECT c_name AS username, certs FROM (SELECT o_custkey, count(DISTINCT o_orderkey) AS certs FROM orders
  WHERE o_orderstatus = 'F' GROUP BY o_custkey) JOIN customer ON c_custkey = o_custkey""")
def user_certificates(spark, sf_dir):
    _user_views(spark, sf_dir)
    return run_report(spark, "student_certs")


@query("""SELECT c_name AS username, c_name || '@example.org' AS email, c_custkey AS id, c_acctbal > 0 AS is_active,
  (1950 + c_nationkey)::BIGINT AS year_of_birth, c_mktsegment AS gender, c_nationkey::BIGINT AS level_of_education FROM customer""")
def user_profile(spark, sf_dir):
    _user_views(spark, sf_dir)
    return run_report(spark, "basic_info").select(
        "username", "email", "id", "is_active", F.col("year_of_birth").cast("bigint").alias("year_of_birth"), "gender",
        F.col("level_of_education").cast("bigint").alias("level_of_education"),
    )


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS items FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def count_distinct_by_key(spark, sf_dir):
    return distinct_by_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F")


_GROUPED = """SELECT lang, source, count(*) AS n, sum({hit})::BIGINT AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang, source"""
_BOUNDS = f"""WITH g AS (SELECT 'quality' AS label, * FROM ({_GROUPED.format(hit="quality")})
  UNION ALL SELECT 'toxic', * FROM ({_GROUPED.format(hit="toxic")})
  UNION ALL SELECT 'all', 'all', 'all', count(*), sum(quality)::BIGINT FROM labels),
w AS (SELECT g.*, i, CASE WHEN k = 0 THEN 1.0 ELSE pow(i / 1000.0, k::DOUBLE) END * CASE WHEN n = k THEN 1.0 ELSE pow((1000 - i) / 1000.0, (n - k)::DOUBLE) END AS p
  FROM g, range(1001) r(i) WHERE k < 40),
m AS (SELECT *, p / sum(p) OVER (PARTITION BY label, lang, source) AS q FROM w),
c AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY label, lang, source ORDER BY q DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
SELECT label, lang, source, n, k, round(min(i) / 1000.0, 3) AS low, round(arg_max(i, q) / 1000.0, 3) AS mode, round(max(i) / 1000.0, 3) AS high
FROM c WHERE before < 0.95 GROUP BY label, lang, source, n, k
UNION ALL SELECT label, lang, source, n, k::BIGINT, round(k / n - 1.96 * sqrt(k / n * (1 - k / n) / n), 3), round(k / n, 3),
  round(k / n + 1.96 * sqrt(k / n * (1 - k / n) / n), 3) FROM (SELECT label, lang, source, n, k::DOUBLE AS k FROM g WHERE k >= 40)"""


@query(_BOUNDS)
def proportion_bounds(spark, sf_dir):
    labels, documents = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    grouped = labels.join(documents, "doc_id").groupBy("lang", "source")
    parts = [
        grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).cast("bigint").alias("k")).select(
            F.lit(hit).alias("label"), "lang", "source", "n", "k")
        for hit in ("quality", "toxic")
    ]
    everything = F.lit("all")
    parts.append(labels.agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("bigint").alias("k")).select(
        everything.alias("label"), everything.alias("lang"), everything.alias("source"), "n", "k"))
    rounded = [F.round(c, 3).alias(c) for c in ("low", "mode", "high")]
    return bounds(reduce(lambda a, b: a.unionByName(b), parts)).select("label", "lang", "source", "n", "k", *rounded)


@query("""SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice::INT) - 1 AS position,
  l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice::INT AS line FROM lineitem""")
def sorted_positions(spark, sf_dir):
    lines = _lineitem_lines(spark, sf_dir)
    return number_rows(lines, "l_shipdate", "line").select("position", "line")


def _lineitem_lines(spark, sf_dir):
    price = F.bround("l_extendedprice").cast("int")
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price)
    return table(spark, sf_dir, "lineitem").select("l_shipdate", line.alias("line"))


@query("""SELECT l_shipdate, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice::INT AS line FROM lineitem""")
def big_sort(spark, sf_dir):
    return sort_big(_lineitem_lines(spark, sf_dir), F.col("l_shipdate"), "line")


@query("SELECT c_custkey AS id, c_name AS username FROM customer ORDER BY c_custkey LIMIT 10")
def peek(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    return first_rows(users, 10, "id")


@query("""SELECT row_number() OVER (ORDER BY o_totalprice DESC, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) - 1 AS position, o_orderkey, o_orderstatus FROM orders""")
def merge_sorted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    # each status is an input of its own, sorted by price, equal prices by key
    runs = [number_rows(orders.where(F.col("o_orderstatus") == s), F.col("o_totalprice").desc(), "o_orderkey", name="place") for s in ("F", "O", "P")]
    merged = merge(runs, "o_totalprice", "place")
    return number_rows(merged).select("position", "o_orderkey", "o_orderstatus")


@query("""SELECT 'i4x.' || source || '.' || lang || '.a_' || doc_id || '.problem' AS id,
  CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'inner ' || n_chars ELSE '[' || n_chars || ',null]' END AS data,
  '{"n":' || n_chars || '}' AS metadata FROM documents WHERE lang <> 'de'""")
def export_resources(spark, sf_dir):
    kind = F.col("doc_id") % 3
    body = (
        F.when(kind == 0, F.to_json(F.array("text")))
        .when(kind == 1, F.concat(F.lit('[{"data": "inner '), "n_chars", F.lit('", "other": 1}]')))
        .otherwise(F.concat(F.lit("[["), "n_chars", F.lit(", null]]")))
    )
    items = table(spark, sf_dir, "documents").select(
        F.struct(
            F.lit("i4x").alias("tag"), F.col("source").alias("org"), F.col("lang").alias("course"),
            F.concat(F.lit("a/"), "doc_id").alias("name"),
            F.when(F.col("lang") == "de", "video").otherwise("problem").alias("category"),
        ).alias("_id"),
        F.struct(F.variant_get(F.parse_json(body), "$[0]", "variant").alias("data")).alias("definition"),
        F.parse_json(F.concat(F.lit('{"n": '), "n_chars", F.lit("}"))).alias("metadata"),
    )
    return export(items, "problem")
