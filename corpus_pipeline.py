"""From raw documents to token ids: quality, near duplicates, secrets, source mix, encoding.

Each stage gets what the one before kept, as Parquet, and gives the columns of `documents`; the last gives token ids.
NULL and empty texts go in the first stage; repeated rows of one doc_id stay together until the mix; tables without rows
pass through; extra columns are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.llm.bpe import encode_texts
from eventmill.llm.common import saved
from eventmill.llm.mixing import mixed_rows
from eventmill.llm.ngram_join import SENT_IDS, link_components
from eventmill.llm.quality import score_quality
from eventmill.llm.secrets import redact_secrets
from eventmill.plans.registry import query
from eventmill.plans.workload import table
from eventmill.session import bound_buffers, scratch_path


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier with its host and path posteriors keeps."""
    return _columns(score_quality(docs, table(spark, sf_dir, "labels")).where("keep"), docs)


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents alike to 0.8 in five-word shingles, the one with the smallest id."""
    found = link_components(docs, width=5, percent=80)
    gone = saved(found.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    small = gone.count() <= SENT_IDS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; `n_chars` follows."""
    bound_buffers(spark)
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return _columns(mixed_rows(docs), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id, source, lang, n_tokens, token_ids`."""
    bound_buffers(spark)
    ids = encode_texts(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", first_of_near_copies),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding", encoded),
]

#: SQL expresses neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


@query(ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
