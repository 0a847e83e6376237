"""Language of documents by a byte network, learnt from labelled documents of the same table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.llm.byte_network import WINDOW, Network, Reader, train, windows_of
from eventmill.llm.common import fresh

#: Documents the network is fitted on, over all languages, and at least per language; windows of each.
FITTED, FITTED_EACH, FITTED_WINDOWS = 4000, 40, 4
UNKNOWN = "und"


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(id_column: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % parts == part


def sample_windows(df: DataFrame, text: str, lang: str, learn: Column) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Learned languages, windows and their language numbers: a bounded sample of the rows that `learn` picks.

    Every language counts all its rows first. A row is taken by a hash of its text, so that reruns agree and tasks send
    about as many rows as are used; windows begin at places that the hash picks anywhere in the text.
    """
    t = F.col(f"`{text}`")
    known = df.where(F.coalesce(learn, F.lit(False)) & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), t.alias("text"))
    known = known.where(has_letter(F.col("text")))
    counts = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, WINDOW), np.int64), np.zeros(0, np.int64)
    quota = max(FITTED_EACH, FITTED // len(langs))
    # twice the quota on average, so that hardly any language falls short of it
    shares = F.create_map(*[F.lit(x) for lang_ in langs for x in (lang_, min(1.0, 2 * quota / counts[lang_]))])
    spot = lambda k: F.pmod(F.xxhash64("text", F.lit(k)), F.lit(1 << 30))
    taken = known.withColumn("u", spot(0) / float(1 << 30)).where(F.col("u") < shares[F.col("lang")])
    span = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    cuts = [F.substr("text", (F.pmod(spot(k + 1), span) + 1).cast("int"), F.lit(WINDOW)).alias(f"t{k}") for k in range(FITTED_WINDOWS)]
    rows = sorted(taken.select("lang", "u", *cuts).collect(), key=lambda r: tuple(r))
    found, labels, used = [], [], dict.fromkeys(langs, 0)
    for row in rows:
        if used[row["lang"]] >= quota:
            continue
        used[row["lang"]] += 1
        for k in range(FITTED_WINDOWS):
            # every second window is cut short, as short texts and ends of texts are
            size = WINDOW if k % 2 == 0 else 4 + int(row["u"] * 2**20) % 60
            found.append(row[f"t{k}"].encode()[:size])
            labels.append(langs.index(row["lang"]))
    sizes = np.array([len(data) for data in found])
    windows = windows_of(np.frombuffer(b"".join(found), np.uint8), np.cumsum(sizes) - sizes, sizes)
    return langs, windows.T.copy(), np.array(labels)


def _predictor(net: Network, langs: list[str], text: str, pred: str, score: str):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net)
        for batch in batches:
            texts = batch.column(text).cast(pa.large_string()).fill_null("")
            ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            logs = reader.read(data, ends[1:] - ends[0])
            best = logs.argmax(1)
            sure = np.exp(logs - logs.max(1, keepdims=True))
            found = {pred: pa.array([langs[i] for i in best.tolist()], pa.string()), score: pa.array(1 / sure.sum(1))}
            rest = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *found.values()], names=[*rest, *found])

    return predict


def predict_language(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", **training) -> DataFrame:
    """The rows without their text, with `lang_pred` and `score` (0 to 1) instead.

    A byte network with filters of several widths, max pooling and a softmax is fitted in numpy on windows of a bounded
    sample (`FITTED` rows over all languages, `FITTED_EACH` of each at least) of the rows that `learn` picks and whose
    language is not NULL; only their text and language are used. Every text is read whole, in windows of `WINDOW` bytes;
    the language of the greatest mean log probability is predicted, ties to the first name, and `score` is its share.

    Texts that are NULL or have no letter are `und` with score 0, and so is everything if there is nothing to learn from.
    With a single language all other texts are of it. Repeated rows get equal answers; very long texts are read a bounded
    number of windows at a time; columns of the result's names are replaced, others kept; an empty table gives no rows.
    """
    langs, windows, labels = sample_windows(df, text, lang, learn)
    readable, = fresh(df, "readable")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (text, "lang_pred", "score")]
    rows = df.select(*rest, has_letter(F.col(f"`{text}`")).alias(readable), F.col(f"`{text}`").alias("lang_pred"))
    rows = rows.withColumn("lang_pred", F.when(F.col(readable), F.col("lang_pred")))
    if not langs:
        return rows.drop(readable).withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    net = train(windows, labels, len(langs), **training)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "lang_pred"])
    schema = schema.add("lang_pred", "string").add("score", "double")
    found = rows.mapInArrow(_predictor(net, langs, "lang_pred", "lang_pred", "score"), schema)
    kept = [F.col(f"`{f.name}`") for f in schema.fields[:-2] if f.name != readable]
    known = F.col(f"`{readable}`")
    return found.select(*kept, F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, F.col("score")).otherwise(0.0).alias("score"))
