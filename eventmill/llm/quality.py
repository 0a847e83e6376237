"""Quality classifier: a document's own evidence combined with posteriors of its host and path by empirical Bayes."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.llm.common import fresh, saved
from eventmill.session import bound_batches

#: Labelled rows the classifier is fitted on at most, by hash of the id; scores and site statistics use all rows.
FITTED_ROWS = 20_000
FEATURES = ("symbols", "capitals", "digits", "repeated", "distinct", "length", "words", "lines", "bare", "first_quarter", "last_quarter")

_PLAIN = re.compile(r"[\w\s.,;:'\"()?-]+")
_NO_CAPITAL = re.compile(r"[^A-ZÀ-ÖØ-Þ]+")
_DIGIT = re.compile(r"\D+")


def features(text: str) -> list[float]:
    """What a document shows of its own; all zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    chars, n = max(1, len(text) - text.count(" ")), len(words)
    quarter = max(1, len(text) // 4)

    def odd(part: str) -> float:
        return len(_PLAIN.sub("", part)) / max(1, len(part))

    lines = [line for line in text.split("\n") if line]
    return [
        len(_PLAIN.sub("", text)) / chars,
        len(_NO_CAPITAL.sub("", text)) / chars,
        len(_DIGIT.sub("", text)) / chars,
        sum(map(str.__eq__, words, words[1:])) / n,
        math.log(len(set(words))) / math.log(n + 1),
        math.log(chars / n),
        math.log(n),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(1 for w in words if len(w) == 1 and not w.isalnum()) / n,
        odd(text[:quarter]),
        odd(text[-quarter:]),
    ]


def with_features(df: DataFrame, name: str, column: str = "text") -> DataFrame:
    """Add an array column of `FEATURES`; NULL counts as the empty text.

    Texts go to Python alone and only numbers come back, so no task holds whole rows there or gets the texts back.
    """

    @F.arrow_udf("array<double>")
    def found(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.float64())
        parts = (texts.slice(at, 500) for at in range(0, len(texts), 500))
        return pa.concat_arrays([pa.array([], kind), *(pa.array([features(t or "") for t in part.to_pylist()], kind) for part in parts)])

    bound_batches(df.sparkSession)
    return df.withColumn(name, found(F.col(f"`{column}`")))


@dataclass(frozen=True)
class Fitted:
    """Weights, bias, and the range of each feature in the rows it was fitted on."""

    weights: list[float]
    bias: float
    low: list[float]
    high: list[float]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Fitted:
    """Logistic regression by Newton steps; without both classes, no evidence at all."""
    if len(y) == 0 or y.min() == y.max():
        return Fitted(*[[0.0] * len(FEATURES), 0.0, [0.0] * len(FEATURES), [0.0] * len(FEATURES)])
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    hold = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + hold, z.T @ (y - p) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    own = w[:-1] / scale
    return Fitted(own.tolist(), float(w[-1] - own @ mean), x.min(0).tolist(), x.max(0).tolist())


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _evidence(name: str, fitted: Fitted) -> Column:
    """Log odds of a row; a feature outside what the fitted rows show counts as the nearest that they show."""
    total = F.lit(fitted.bias)
    for k, (w, low, high) in enumerate(zip(fitted.weights, fitted.low, fitted.high, strict=True)):
        total = total + F.least(F.greatest(F.get(F.col(name), F.lit(k)), F.lit(low)), F.lit(high)) * F.lit(w)
    return F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))


def strength(sites: DataFrame, mean: float) -> float:
    """How many documents the prior of a site is worth, from how far sites of more than one document lie apart.

    Moments of a beta distribution: sites that differ no more than chance would have it shrink to the prior completely.
    """
    row = sites.where("n > 1").agg(
        F.sum(F.col("n") * (F.col("good") / F.col("n") - F.lit(mean)) ** 2).alias("between"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")
    ).first()
    if not row["k"] or row["k"] < 2:
        return 1e4
    spread, chance = row["between"] / row["n"], mean * (1 - mean)
    excess = spread - chance * row["k"] / row["n"]
    return float(min(1e4, max(1.0, chance / excess - 1))) if excess > 0 else 1e4


class QualityModel:
    """Fitted evidence weights, and a saved table `_host, _path, host_prior, path_prior` of all sites."""

    def __init__(self, fitted: Fitted, mean: float, sites: DataFrame, host: str, path: str):
        self.fitted, self.mean, self.sites, self.host, self.path = fitted, mean, sites, host, path

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """Add `evidence`, `host_prior`, `path_prior`, `quality` to rows with the features column `name`."""
        h, p, e = fresh(df, "_host", "_path", "_evidence")
        keyed = df.withColumn(h, F.coalesce(F.col(f"`{self.host}`"), F.lit(""))).withColumn(p, F.coalesce(F.col(f"`{self.path}`"), F.lit("")))
        sites = self.sites.select(F.col("host").alias("_of_host"), F.col("path").alias("_of_path"), "host_prior", "path_prior")
        joined = keyed.withColumn(e, _evidence(name, self.fitted)).join(
            sites, (F.col(h) == F.col("_of_host")) & (F.col(p) == F.col("_of_path")), "left"
        )
        shift = _logit(F.col("path_prior")) - _logit(F.lit(self.mean))
        words = F.get(F.col(name), F.lit(5)) > 0
        posterior = F.when(words, 1 / (1 + F.exp(-(F.col(e) + F.coalesce(shift, F.lit(0.0)))))).otherwise(F.lit(0.0))
        return joined.withColumn("quality", posterior).withColumn("evidence", 1 / (1 + F.exp(-F.col(e)))).drop(h, p, e, "_of_host", "_of_path")


def fit_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", rows: int = FITTED_ROWS) -> QualityModel:
    """Fit the classifier on labelled rows and the site posteriors on all rows.

    `labels` has `doc_id, quality` (0 or 1). At most `rows` labelled documents are fetched to fit the eleven weights. The
    expected good documents of every host and of every path of it are summed over all documents; a host shrinks to the
    global rate, a path to its host, as many documents' worth as the spread of the sites says. A NULL host
    or path is the same site as an empty one. Labels that are NULL, or repeat with different values, do not count.
    """
    narrow = docs.select("doc_id", F.coalesce(F.col(f"`{host}`"), F.lit("")).alias("host"), F.coalesce(F.col(f"`{path}`"), F.lit("")).alias("path"), "text")
    known = saved(with_features(narrow, "f").drop("text"), "quality-features")
    sure = labels.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z").select("doc_id", "y")
    sample = known.select("doc_id", "f").join(sure, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toPandas()
    x = np.array(sample["f"].tolist(), float).reshape(-1, len(FEATURES))
    fitted = fit(x, (sample["y"].to_numpy(float) > 0).astype(float))
    p = 1 / (1 + F.exp(-_evidence("f", fitted)))
    paths = saved(known.groupBy("host", "path").agg(F.sum(p).alias("good"), F.count(F.lit(1)).alias("n")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    good, n = paths.agg(F.sum("good"), F.sum("n")).first()
    mean = good / n if n else 0.5
    m = strength(hosts, mean)
    by_host = hosts.select("host", ((F.col("good") + F.lit(m * mean)) / (F.col("n") + F.lit(m))).alias("host_prior"))
    m_path = strength(paths, mean)
    joined = paths.join(by_host, "host")
    sites = joined.select("host", "path", "host_prior", ((F.col("good") + F.lit(m_path) * F.col("host_prior")) / (F.col("n") + F.lit(m_path))).alias("path_prior"))
    return QualityModel(fitted, mean, saved(sites, "quality-sites"), host, path)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """All rows of `docs` with `evidence` (of the document alone), `host_prior`, `path_prior`, `quality` and `keep`.

    The odds of the document are multiplied by the odds of its path over the global odds; `keep` says whether the result
    reaches `threshold`. Texts that are NULL or have no words have quality 0. Repeated rows get equal scores; an empty
    table gives an empty table; columns with the names of the result are replaced.
    """
    names = ("evidence", "host_prior", "path_prior", "quality", "keep")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    model = fit_quality(docs, labels, **options)
    (f,) = fresh(docs, "_features")
    return model.score(with_features(docs, f), f).withColumn("keep", F.col("quality") >= threshold).drop(f)
