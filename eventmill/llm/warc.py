"""WARC archives of pages: repeated payloads become revisit records that refer to the first response."""

from __future__ import annotations

import gzip
import hashlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.llm.common import fresh

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"

RECORDS = "page_id bigint, url string, record_type string, record_id string, refers_to_id string, payload_digest string, payload string"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: every 20 bits of the 160 give four digits."""
    digits, hexadecimal = [], F.sha1(payload)
    for at in range(1, 41, 5):
        number = F.conv(F.substring(hexadecimal, at, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(_BASE32), F.shiftright(number, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def resolve_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add `payload_bytes, payload_digest, record_type, refers_to` to rows of `page_id, url, html`.

    The payload is the html in UTF-8, empty for NULL. Of rows with equal payloads of at least `least_bytes` bytes, those
    with the smallest page_id are responses, all others revisit it; smaller payloads are responses. A NULL page_id comes
    after all others, and is a response only where no row with that payload has an id; repeated rows of the smallest id
    are responses all. Digests are reduced to one row each before they are shuffled, so a frequent payload is no burden.
    """
    names = ("payload_bytes", "payload_digest", "record_type", "refers_to")
    keep = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in names]
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(*keep, F.octet_length(payload).cast("long").alias("payload_bytes"), payload_digest(payload).alias("payload_digest"))
    first, digest = fresh(keyed, "_first", "_digest")
    repeated = (
        keyed.where(F.col("payload_bytes") >= least_bytes)
        .groupBy(F.col("payload_digest").alias(digest))
        .agg(F.min("page_id").alias(first), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    joined = keyed.join(repeated, (F.col("payload_digest") == F.col(digest)) & (F.col("payload_bytes") >= least_bytes), "left")
    revisit = F.col(digest).isNotNull() & ~F.col("page_id").eqNullSafe(F.col(first))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col(first))
    ).drop(first, digest)


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.col("payload_digest"), F.lit(">"))


def record_text(date: str) -> Column:
    """A record without the empty lines that end it, for rows of `resolve_revisits`."""
    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.lit(_HTTP), F.when(revisit, "").otherwise(F.coalesce(F.col("html"), F.lit(""))))
    url = F.col("url")
    for character in " \t\r\n":
        url = F.replace(url, F.lit(character), F.lit(f"%{ord(character):02X}"))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(lines, F.lit(_END), block)


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 4000) -> None:
    """Write rows of `resolve_revisits` as gzipped WARC files, a record each; the writer's line end closes a record."""
    records = resolved.select(record_text(date).alias("value"))
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_archive(content: bytes) -> Iterator[dict]:
    """Records of one archive. Their lengths frame them, so payloads may hold anything."""
    data, at = memoryview(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content), 0
    raw = data.obj
    while at < len(data):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        start, size = end + 4, int(headers["content-length"])
        body = raw.index(b"\r\n\r\n", start, start + size) + 4
        at = start + size + 4
        kind, record = headers["warc-type"], headers["warc-record-id"]
        payload = bytes(data[body : start + size]) if kind == "response" else None
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if payload is not None and b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {record} does not have its digest")
        page = record.split(":")[2]
        yield {
            "page_id": int(page) if page else None,
            "url": headers.get("warc-target-uri"),
            "record_type": kind,
            "record_id": record,
            "refers_to_id": headers.get("warc-refers-to"),
            "payload_digest": digest,
            "payload": None if payload is None else payload.decode(),
        }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below a path: `RECORDS`; `payload` is NULL for revisits."""
    schema = pa.schema(
        [("page_id", pa.int64()), *[(n, pa.string()) for n in ("url", "record_type", "record_id", "refers_to_id", "payload_digest", "payload")]]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for row in parse_archive(content.as_py()):
                    rows.append(row)
                    size += len(row["payload"] or "")
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, RECORDS)


def with_payload_size(records: DataFrame) -> DataFrame:
    """Per record `page_id, payload_bytes, payload_digest, record_type, refers_to`, revisits joined to what they repeat."""
    sized = records.select("*", F.octet_length("payload").cast("long").alias("own_bytes")).drop("payload", "url")
    originals = (
        sized.where("record_type = 'response'").groupBy(F.col("record_id").alias("of")).agg(
            F.max("own_bytes").alias("of_bytes"), F.max("page_id").alias("of_page"), F.max("payload_digest").alias("of_digest")
        )
    )
    return sized.join(originals, F.col("refers_to_id") == F.col("of"), "left").select(
        "page_id",
        F.coalesce("own_bytes", "of_bytes").alias("payload_bytes"),
        F.coalesce("of_digest", "payload_digest").alias("payload_digest"),
        "record_type",
        F.col("of_page").alias("refers_to"),
    )
