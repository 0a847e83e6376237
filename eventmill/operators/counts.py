"""Counts, distinct values and bounds for proportions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventmill.functions.once import let
from eventmill.functions.paths import event_field


def event_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("events"))


def users_count(df: DataFrame, path: str = "username", include_missing: bool = True, approximate: bool = False) -> DataFrame:
    """Distinct users; all events without a user count as one more."""
    user = event_field(df, path)
    distinct = F.approx_count_distinct(user) if approximate else F.count_distinct(user)
    missing = F.coalesce(F.max(user.isNull().cast("int")), F.lit(0)) if include_missing else F.lit(0)
    return df.agg((distinct + missing).cast("bigint").alias("users"))


def field_set(df: DataFrame, path: str) -> DataFrame:
    """Distinct values of a path, NULL included."""
    return df.select(event_field(df, path).alias(path)).distinct()


def count_distinct_by_key(df: DataFrame, key: str, item: str, condition: Column, name: str = "items") -> DataFrame:
    """Distinct items per key among the rows that meet the condition."""
    return df.where(condition).groupBy(key).agg(F.count_distinct(item).alias(name))


def item_count_probe(df: DataFrame, label: str) -> tuple[DataFrame, Observation | None]:
    """Count rows as they pass: run the frame, then read `observation.get["rows"]`.

    A stream has a count per micro-batch and no observation; `streaming.ingest.PassingRows` sums them up.
    """
    rows = F.count(F.lit(1)).alias("rows")
    if df.isStreaming:
        return df.observe(label, rows), None
    observation = Observation(label)
    return df.observe(observation, rows), observation


# Cells of the grid, mass to reach, normal quantile.
GRID = 1000
MASS = 0.95
QUANTILE = 1.96


def proportion_bounds(df: DataFrame, n: str = "n", k: str = "k", cutoff: int = 40) -> DataFrame:
    """Add `low, mode, high`: 95% bounds for k successes in n trials.

    Below the cutoff the posterior of a uniform prior is summed over a grid, from its peak outwards; the grid is an
    array inside the row. From the cutoff on the normal approximation is used.
    """
    trials, successes = F.col(n).cast("double"), F.col(k).cast("double")
    failures = trials - successes

    def log_weight(i: Column) -> Column:
        # 0 * log(0) is 0 here
        hit = F.when(successes == 0, 0.0).when(i > 0, successes * F.ln(i / GRID))
        miss = F.when(failures == 0, 0.0).when(i < GRID, failures * F.ln((F.lit(GRID) - i) / GRID))
        return hit + miss

    start = F.struct(*[F.lit(x).alias(name) for x, name in ((0.0, "mass"), (GRID + 1, "low"), (-1, "high"), (-1, "mode"))])

    def by_weight(logs: Column) -> Column:
        # scaled by the peak, so that large counts do not underflow; negative, so that the heaviest cell comes first
        def cells(peak: Column) -> Column:
            return F.transform(
                logs, lambda w, i: F.struct((-F.coalesce(F.exp(w - peak), F.lit(0.0))).alias("weight"), i.alias("cell"))
            )

        return F.array_sort(let(F.array_max(logs), cells))

    def interval(cells: Column) -> Column:
        def from_peak(total: Column) -> Column:
            def take(state: Column, cell: Column) -> Column:
                taken = F.struct(
                    (state["mass"] + cell["weight"] / total).alias("mass"),
                    F.least(state["low"], cell["cell"]).alias("low"),
                    F.greatest(state["high"], cell["cell"]).alias("high"),
                    F.when(state["mode"] < 0, cell["cell"]).otherwise(state["mode"]).alias("mode"),
                )
                return F.when(state["mass"] < MASS, taken).otherwise(state)

            return F.aggregate(cells, start, take)

        return let(F.aggregate(cells, F.lit(0.0), lambda total, cell: total + cell["weight"]), from_peak)

    small = F.col(k) < cutoff
    logs = F.transform(F.sequence(F.lit(0), F.lit(GRID)), log_weight)
    bounds = df.withColumn("_grid", F.when(small, let(let(logs, by_weight), interval)))
    mean = successes / trials
    margin = F.lit(QUANTILE) * F.sqrt(mean * (1 - mean) / trials)

    def pick(name: str, normal: Column) -> Column:
        return F.when(small, F.col("_grid")[name] / GRID).otherwise(normal).alias(name)

    return bounds.select(
        *[F.col(c) for c in df.columns], pick("low", mean - margin), pick("mode", mean), pick("high", mean + margin)
    )
