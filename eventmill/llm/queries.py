"""The corpus operators as queries over the driver tables, next to SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.llm.bpe import encode_texts
from eventmill.llm.collocations import top_collocations
from eventmill.llm.hard_negatives import mine_hard_negatives
from eventmill.llm.html_text import extract_text
from eventmill.llm.language_id import held_out, predict_language
from eventmill.llm.mixing import mix_sources
from eventmill.llm.neighbours import nearest_neighbours
from eventmill.llm.ngram_join import link_components
from eventmill.llm.quality import score_quality
from eventmill.llm.secrets import ACCESS, ALLOWED, ASSIGN, ASSIGN_VALUE, BASE, CLASSES, HEX, KINDS, SAMPLES, described, scan_secrets
from eventmill.llm.sharding import shard_by_curve
from eventmill.llm.topk import top_products
from eventmill.llm.warc import read_archives, resolve_revisits, with_payload_size, write_archives
from eventmill.plans.registry import query
from eventmill.plans.workload import table
from eventmill.session import scratch_path


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_matches(kind: str, pattern: str, least: str = "TRUE", texts: str = "texts") -> str:
    """Matches with code point positions: the text between matches and the matches themselves, added up."""
    p = _quoted(pattern)
    return f"""
    SELECT doc_id, '{kind}' AS kind, m AS value, list_sum(list_transform(gaps[1:i], lambda g: length(g)))
      + coalesce(list_sum(list_transform(found[1:i-1], lambda f: length(f))), 0) AS start
    FROM (SELECT doc_id, gaps, found, unnest(found) AS m, unnest(range(1, len(found) + 1)) AS i
          FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS found, string_split_regex(t, {p}) AS gaps FROM {texts})
          WHERE len(found) > 0)
    WHERE {least}"""


_BASE_SQL = f"""
  SELECT doc_id, kind, start::BIGINT AS s, (start + length(value))::BIGINT AS e FROM (
    {_sql_matches("assign", ASSIGN, f"length(regexp_extract(m, {_quoted(ASSIGN)}, 2)) >= {ASSIGN_VALUE}")}
    UNION ALL {_sql_matches("access", ACCESS)} UNION ALL {_sql_matches("hex", HEX)})"""


def _sql_entropy(group) -> str:
    """Every window of every candidate measured anew; windows that touch are one span."""
    run, width = rf"[{group.members}]{{{group.window},}}", group.window
    keep = " AND ".join(
        [f"regexp_matches(value, {_quoted(n)})" for n in group.needs] + [f"NOT regexp_matches(value, {_quoted(a.replace('++', '+'))})" for a in ALLOWED]
    )
    table_ = "[" + ", ".join(map(str, group.table)) + "]"
    return f"""
    SELECT doc_id, '{group.kind}' AS kind, (start + min(w))::BIGINT AS s, (start + max(w) + {width})::BIGINT AS e FROM (
      SELECT *, sum(new_) OVER (PARTITION BY doc_id, start ORDER BY w) AS island FROM (
        SELECT *, CASE WHEN w - lag(w) OVER (PARTITION BY doc_id, start ORDER BY w) <= {width} THEN 0 ELSE 1 END AS new_ FROM (
          SELECT doc_id, start, value, unnest(range(0, length(value) - {width} + 1)) AS w FROM ({_sql_matches(group.kind, run, texts="measured")}) WHERE {keep})
        WHERE list_sum(list_transform(map_values(list_aggregate(string_split(substr(value, (w + 1)::INT, {width}), ''), 'histogram')),
                                      lambda n: ({table_})[n::INT + 1])) <= {group.bound}))
    GROUP BY doc_id, start, island"""


_SPAN_TEXT = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
_KIND_ORDER = f"list_position({list(KINDS)}, kind) AS k"
_MEASURED_SQL = "t"
for _size, _words in SAMPLES.items():
    _MEASURED_SQL = f"regexp_replace({_MEASURED_SQL}, '{_words}', repeat(' ', {_size}), 'g')"

OP1_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
measured AS (SELECT doc_id, {_MEASURED_SQL} AS t FROM texts),
base AS (SELECT *, {_KIND_ORDER} FROM ({_BASE_SQL})),
more AS (SELECT *, {_KIND_ORDER} FROM ({" UNION ALL ".join(_sql_entropy(g) for g in CLASSES)}) m
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.s <= m.s AND m.e <= b.e)),
b AS (SELECT doc_id, {_SPAN_TEXT} AS spans, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)} FROM base GROUP BY doc_id),
a AS (SELECT doc_id, {_SPAN_TEXT} AS spans FROM (FROM base UNION ALL FROM more) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id
"""


@query(OP1_SQL)
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(described(F.col("base")), 256).alias("base_sha256"), described(F.col("spans")).alias("spans"))


OP6_SQL = """
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
    ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sized GROUP BY source),
levels AS (SELECT *, sum(cap) OVER w AS caps, sum(weight) OVER w AS weights FROM sources
    WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tried AS (SELECT cap, weight, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources) - coalesce(caps, 0))
    / ((SELECT sum(weight) FROM sources) - coalesce(weights, 0)) AS level FROM levels),
targets AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT max(level) FROM tried WHERE weight * level <= cap)) AS target
    FROM sources),
placed AS (SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
    ('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS n
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(n * each + shift) - floor((n - 1) * each + shift)))::BIGINT AS taken FROM placed
"""


@query(OP6_SQL)
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query()
def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: no shard has two rows more than another."""
    cut = shard_by_curve(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("""
SELECT q.query_id, q.rank, q.vec_id, q.score FROM (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score,
    (row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id))::INT AS rank
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) q WHERE q.rank <= 5
""".replace("FROM v a JOIN v b", "FROM {v} a JOIN {v} b").format(
    v="(SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings)"
))
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query()
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


_BASE32_SQL = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {at}, 5))::INT >> {s}) & 31) + 1, 1)"
    for at in range(1, 41, 5)
    for s in (15, 10, 5, 0)
)


@query(f"""
SELECT page_id, payload_bytes, {_BASE32_SQL} AS payload_digest,
  CASE WHEN page_id = min(page_id) OVER (PARTITION BY h) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER (PARTITION BY h) THEN min(page_id) OVER (PARTITION BY h) END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages) p
""")
def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(resolve_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    return with_payload_size(read_archives(spark, path))


@query()
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, path, public_tokenizers.PATTERN, decoded="decoded").select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"), width=4, percent=85)


@query()
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents name no URL: the source is the host, the language the path below it."""
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "evidence", "host_prior", "path_prior", "quality", "keep")


@query()
def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def _grams_sql() -> str:
    """All phrases of one to four words, by language, with their counts."""
    spread = ", ".join(f"lead(w, {k - 1}) OVER (PARTITION BY doc, piece ORDER BY pos) AS w{k}" for k in (2, 3, 4))
    counts = " UNION ALL ".join(
        f"SELECT lang, {', '.join(f'w{k}' for k in range(1, size + 1))}{', NULL' * (4 - size)}, count(*) AS f FROM spread "
        f"WHERE w{size} IS NOT NULL GROUP BY ALL" for size in (1, 2, 3, 4)
    )
    return f"""
pieces AS (SELECT doc, lang, unnest(p) AS t, unnest(range(len(p))) AS piece FROM (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
ws AS (SELECT doc, lang, piece, unnest(w) AS w, unnest(range(len(w))) AS pos FROM (
    SELECT doc, lang, piece, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM pieces)),
spread AS (SELECT lang, w AS w1, {spread} FROM ws),
grams(lang, w1, w2, w3, w4, f) AS ({counts})"""


@query(f"""
WITH {_grams_sql()},
f AS MATERIALIZED (SELECT lang, concat_ws(' ', w1, w2, w3, w4) AS phrase, len(list_filter([w1, w2, w3, w4], lambda x: x IS NOT NULL)) AS size,
    list_filter([w1, w2, w3, w4], lambda x: x IS NOT NULL) AS ws, f FROM grams WHERE f >= 30),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail
    FROM f c, range(1, 4) t(k) WHERE c.size >= 2 AND k < c.size),
scored AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, (2000000 * c.a::HUGEINT // (x.f + y.f))::BIGINT AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 2000000 * c.a::HUGEINT // (x.f + y.f), k) = 1),
inside AS (SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(f) AS by_ FROM f, range(1, 4) t(i), range(2, 5) u(j)
    WHERE size >= 3 AND i < j AND j <= size AND j - i + 1 < size GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM ws GROUP BY lang)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score
FROM scored s JOIN n ON n.lang = s.lang LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
WHERE by_ IS NULL OR 100 * by_ < 80 * a
QUALIFY row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) <= 2000
""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_collocations(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query()
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return predict_language(docs, ~F.col("held_out")).select("doc_id", "held_out", "lang_pred", "score")
