"""The best scored phrases of each language, by branch and bound over growing phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.llm.common import saved
from eventmill.llm.word_codes import _BITS, Filter, counted, digest, phrase_keys, pieces

LONGEST = 4
SCALE = 2_000_000
_BUCKET = 1000
_TRIES = 8
#: Bytes of text of all languages that a task looks at together.
_BYTES = 1 << 23


def _texts(df: DataFrame, text: str, lang: str) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """The texts of each language, some at a time: not more than a text beyond a number of bytes."""
    langs, texts = batch.column("lang").dictionary_encode(), batch.column("text")
    of, sizes = langs.indices.to_numpy(), pa.compute.binary_length(texts).to_numpy()
    group = np.cumsum(sizes, dtype=np.int64) // _BYTES
    for n in np.unique(group).tolist():
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            rows = np.flatnonzero((of == i) & (group == n))
            if len(rows):
                yield lang, texts.take(pa.array(rows))


def _salt(lang: str) -> int:
    return digest(lang.encode(), 0)


def _count_words(docs: DataFrame, seed: int) -> DataFrame:
    """`lang, word, code, n` for all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_lang(batch):
                for codes, _, _, data, starts, stops in pieces(texts, seed, 0):
                    at, n = counted(codes, [codes])
                    words = [data[starts[i] : stops[i]].tobytes() for i in at.tolist()]
                    columns = [pa.array([lang] * len(at), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(codes[at].view(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "code", "n"])

    rows = docs.mapInArrow(count, "lang string, word string, code bigint, n bigint")
    return rows.groupBy("lang", "word", "code").agg(F.sum("n").alias("n"))


def _count_phrases(docs: DataFrame, size: int, seed: int, heads: Filter, tails: Filter, both: bool) -> DataFrame:
    """`lang, w1, ..., a` for phrases whose first size-1 words may be in `heads` or (`both`: and) the last in `tails`."""
    names = [f"w{i}" for i in range(1, size + 1)]
    sent = docs.sparkSession.sparkContext.broadcast((heads.words, tails.words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, tail = (Filter(words) for words in sent.value)
        for batch in batches:
            for lang, texts in _by_lang(batch):
                salt = _salt(lang)
                for codes, segments, old, _, _, _ in pieces(texts, seed, size - 1):
                    if len(codes) < size:
                        continue
                    n = len(codes) - size + 1
                    keys = phrase_keys([codes[k : n + 1 + k] for k in range(size - 1)], salt)
                    begins, ends = head.may_hold(keys[:-1]), tail.may_hold(keys[1:])
                    fits = (begins & ends if both else begins | ends) & (segments[:n] == segments[size - 1 :])
                    # the rest was counted with the piece before
                    fits[: max(0, old - size + 1)] = False
                    places = np.flatnonzero(fits)
                    parts = [codes[places + k] for k in range(size)]
                    at, times = counted(phrase_keys(parts, salt), parts)
                    columns = [pa.array([lang] * len(at), pa.string()), *(pa.array(p[at].view(np.int64)) for p in parts), pa.array(times)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", *names, "a"])

    rows = docs.mapInArrow(count, f"lang string, {', '.join(f'{name} bigint' for name in names)}, a bigint")
    return rows.groupBy("lang", *names).agg(F.sum("a").alias("a"))


def _filter(phrases: DataFrame, words: list[str]) -> Filter:
    """Bits of the phrases: an aggregate, so the driver gets a fixed number of 64-bit words at most."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in set(batch.column("lang").to_pylist()):
                own = batch.filter(pa.compute.equal(batch.column("lang"), lang))
                keys = phrase_keys([own.column(w).to_numpy().view(np.uint64) for w in words], _salt(lang))
                at = np.unique(np.concatenate(Filter.places(keys))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    bits = phrases.select("lang", *words).mapInArrow(places, "at bigint")
    found = bits.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (_BITS - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Filter(out)


def share(part: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * part / (left + right)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    product, total = wide(part) * F.lit(SCALE).cast("decimal(8,0)"), wide(left) + wide(right)
    return F.when(left.isNotNull() & right.isNotNull(), F.call_function("div", product, total).cast("long"))


def _scored(phrases: DataFrame, cuts: list[tuple[Column, Column]]) -> DataFrame:
    """Adds the cut of least score, ties to the first, and what extensions of the phrase may reach at most."""
    each = [F.struct(share(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")) for k, (left, right) in enumerate(cuts)]
    known = [F.when(c["score"].isNotNull(), c) for c in each]
    whole = F.lit(True)
    for c in each:
        whole = whole & c["score"].isNotNull()
    worst = F.when(whole, F.least(*known) if len(known) > 1 else known[0])
    return phrases.withColumn("cut", worst).select(
        "*", F.col("cut.score").alias("score"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        share(F.col("a"), F.col("first"), F.col("a")).alias("ahead"), share(F.col("a"), F.col("last"), F.col("a")).alias("behind"),
    ).drop("cut")


def _renamed(phrases: DataFrame, words: list[str], prefix: str, **columns: str) -> DataFrame:
    taken = [F.col(f"w{i}").alias(word) for i, word in enumerate(words, 1)]
    return phrases.select(F.col("lang"), *taken, *[F.col(old).alias(f"{prefix}{new}") for new, old in columns.items()])


def _pairs(counts: DataFrame, words: DataFrame) -> DataFrame:
    first = words.select("lang", F.col("code").alias("w1"), F.col("n").alias("first"))
    last = words.select("lang", F.col("code").alias("w2"), F.col("n").alias("last"))
    joined = counts.join(first, ["lang", "w1"]).join(last, ["lang", "w2"])
    return _scored(joined, [(F.col("first"), F.col("last"))])


def _triples(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    head = _renamed(pairs, ["w1", "w2"], "", head="a", first="first")
    tail = _renamed(pairs, ["w2", "w3"], "", tail="a", last="last")
    joined = counts.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
    return _scored(joined, [(F.col("first"), F.col("tail")), (F.col("head"), F.col("last"))])


def _quads(counts: DataFrame, triples: DataFrame) -> DataFrame:
    """A part that was not counted cannot bring the phrase to the bound, so its phrase has no score."""
    head = _renamed(triples, ["w1", "w2", "w3"], "", first="first", two="head", three="a")
    tail = _renamed(triples, ["w2", "w3", "w4"], "", rest="a", end="tail", last="last")
    joined = counts.join(head, ["lang", "w1", "w2", "w3"], "left").join(tail, ["lang", "w2", "w3", "w4"], "left")
    return _scored(joined, [(F.col("first"), F.col("rest")), (F.col("two"), F.col("end")), (F.col("three"), F.col("last"))])


def _kept(phrases: DataFrame, longer: DataFrame | None, size: int, percent: int) -> DataFrame:
    """Phrases that no phrase with one more word stands for: longer ones than that cannot be more frequent."""
    names = [f"w{i}" for i in range(1, size + 1)]
    if longer is not None:
        of = [_renamed(longer, names, "", by="a"), longer.select("lang", *[F.col(f"w{i + 1}").alias(f"w{i}") for i in range(1, size + 1)], F.col("a").alias("by"))]
        most = of[0].unionByName(of[1]).groupBy("lang", *names).agg(F.max("by").alias("by"))
        phrases = phrases.join(most, ["lang", *names], "left").where(f"by IS NULL OR 100 * cast(by AS decimal(20,0)) < {percent} * cast(a AS decimal(20,0))")
    absent = [F.lit(None).cast("long").alias(f"w{i}") for i in range(size + 1, LONGEST + 1)]
    return phrases.select("lang", *names, *absent, "a", "l", "r", "score")


def _bounds(pairs: DataFrame, want: int) -> DataFrame:
    """`lang, bound`: the greatest multiple of the bucket that `want` pairs reach, 0 if there are fewer."""
    buckets = pairs.groupBy("lang", F.floor(F.col("score") / _BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("pairs"))
    # a language has not more than a thousand buckets, whatever it has of pairs
    down = Window.partitionBy("lang").orderBy(F.col("bucket").desc())
    reached = buckets.withColumn("reached", F.sum("pairs").over(down))
    return reached.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("reached") >= want, F.col("bucket"))), F.lit(0)).alias("bucket")).select(
        "lang", (F.col("bucket") * _BUCKET).alias("bound")
    )


def top_collocations(df: DataFrame, top: int = 2000, least: int = 30, percent: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: the best phrases of two to four words of each language.

    A to Z count as a to z; words are parted by space and tab, and no phrase goes across any of `.,;:!?` or a line break.
    `a` is how often the phrase occurs, at least `least`; of the ways to cut it in two, the one with the lowest
    floor(2000000 * a / (l + r)) counts, ties to the shortest first part, where l and r are how often the parts occur; `n`
    is the number of words of the language. A phrase goes if a longer one that holds it occurs `percent` in 100 times as
    often. Order: score, a (descending), phrase (by bytes). Counts and scores are exact.

    NULL text is empty, NULL language is `und`. Repeated rows count each. Texts without words give nothing, an empty table
    no rows; other columns are ignored. Texts of any length are taken whole, a bounded piece at a time.

    Words and pairs are counted over all texts. A phrase that extends p and starts with the same word w scores at most
    floor(2000000 * f(p) / (f(w) + f(p))), and so for its last word. Only phrases whose bound reaches a language's
    threshold are extended. The threshold starts where twice as many pairs reach it as are wanted. When fewer than `top`
    phrases at or above it survive, it is lowered and the frontier grows; when as many do, nothing that was left out can
    come before them, ties included. Tasks get filters of a fixed size that pass all phrases of the frontier.
    """
    docs = _texts(df, text, lang)
    for seed in range(_TRIES):
        words = saved(_count_words(docs, seed), "phrases-words")
        same = words.groupBy("code").agg((F.min("word") != F.max("word")).alias("twice")).where("twice")
        if same.isEmpty():
            break
    else:
        raise ValueError(f"different words with equal numbers under each of {_TRIES} seeds")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = saved(words.where(F.col("n") >= least), "phrases-frequent")
    single = _filter(frequent.withColumnRenamed("code", "w1"), ["w1"])
    pairs = saved(_pairs(_count_phrases(docs, 2, seed, single, single, both=True).where(F.col("a") >= least), frequent), "phrases-pairs")
    want, bounds, settled = 2 * top, saved(_bounds(pairs, 2 * top), "phrases-bounds"), []
    while not bounds.isEmpty():
        open_pairs = pairs.join(bounds, "lang")
        heads = _filter(open_pairs.where("ahead >= bound"), ["w1", "w2"])
        tails = _filter(open_pairs.where("behind >= bound"), ["w1", "w2"])
        triples = saved(_triples(_count_phrases(docs, 3, seed, heads, tails, both=False).where(F.col("a") >= least), pairs), "phrases-triples")
        open_triples = triples.join(bounds, "lang")
        heads = _filter(open_triples.where("ahead >= bound"), ["w1", "w2", "w3"])
        tails = _filter(open_triples.where("behind >= bound"), ["w1", "w2", "w3"])
        quads = saved(_quads(_count_phrases(docs, 4, seed, heads, tails, both=False).where(F.col("a") >= least), triples), "phrases-quads")
        reaching = [p.join(bounds, "lang").where("score >= bound").drop("bound") for p in (pairs, triples, quads)]
        kept = _kept(reaching[0], triples, 2, percent).unionByName(_kept(reaching[1], quads, 3, percent)).unionByName(_kept(reaching[2], None, 4, percent))
        kept = saved(kept, "phrases-kept")
        found = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
        state = saved(bounds.join(found, "lang", "left").withColumn("done", (F.col("bound") == 0) | (F.coalesce("found", F.lit(0)) >= top)), "phrases-state")
        settled.append(kept.join(state.where("done").select("lang"), "lang", "left_semi"))
        want *= 4
        lower = F.greatest(F.lit(0), F.least("next", F.col("bound") - _BUCKET)).alias("bound")
        later = _bounds(pairs, want).withColumnRenamed("bound", "next")
        bounds = saved(state.where("NOT done").select("lang", "bound").join(later, "lang").select("lang", lower), "phrases-bounds")
    out = settled[0] if settled else _kept(pairs, None, 2, percent)
    for more in settled[1:]:
        out = out.unionByName(more)
    # a language's rows here are those of its frontier, not all of its phrases
    first = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    best = out.withColumn("place", F.rank().over(first)).where(F.col("place") <= top)
    for i in range(1, LONGEST + 1):
        named = frequent.select("lang", F.col("code").alias(f"w{i}"), F.col("word").alias(f"word{i}"))
        best = best.join(named, ["lang", f"w{i}"], "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *[f"word{i}" for i in range(1, LONGEST + 1)]))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
