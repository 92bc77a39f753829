"""Metrics: matching, calibration, percentiles of offsets, roll-ups, comparison of edits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .streams import sorted_scan
from .tables import percentiles


def greedy_match(detected: DataFrame, truth: DataFrame, keys: Sequence[str], t: str, tolerance: float) -> DataFrame:
    """(keys, tp, fp, fn): detections in ascending time each take the nearest truth of their key not yet taken within
    `tolerance`, the earlier on a tie. Not a maximum matching.

    Both sides stream by in order of time, truths `tolerance` early and detections `tolerance` late, so that all truths
    a detection may take have been seen: the state holds the truths of a span of time, not of a key."""

    def step(state, row):
        waiting = state or []
        when, kind = row
        if kind == 0:  # a truth
            return [*waiting, when], 0
        waiting = [x for x in waiting if x >= when - tolerance]
        near = min((x for x in waiting if abs(x - when) <= tolerance), key=lambda x: (abs(x - when), x), default=None)
        if near is None:
            return waiting, 0
        waiting.remove(near)
        return waiting, 1

    d = detected.select(*keys, F.col(t).cast("double").alias("t"), F.lit(1).alias("kind"))
    g = truth.select(*keys, F.col(t).cast("double").alias("t"), F.lit(0).alias("kind"))
    both = d.unionByName(g).withColumn("at", F.when(F.col("kind") == 0, F.col("t") - 2 * tolerance).otherwise(F.col("t")))
    hit = sorted_scan(both, keys, ["at", "kind", "t"], ["t", "kind"], step, "hit")
    counts = hit.groupBy(*keys).agg(F.sum("hit").cast("long").alias("tp"), F.sum(F.col("kind").cast("long")).alias("d"), F.count("*").alias("n"))
    return counts.select(*keys, "tp", (F.col("d") - F.col("tp")).alias("fp"), (F.col("n") - F.col("d") - F.col("tp")).alias("fn"))


def rates(df: DataFrame) -> DataFrame:
    """Adds precision and recall, 0 where undefined."""
    of = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return df.withColumn("precision", of("tp", "fp")).withColumn("recall", of("tp", "fn"))


def calibration(df: DataFrame, expected: Column, observed: Column, expected_count: Column, observed_count: Column) -> DataFrame:
    """One row: samples, hits, full hits (the count too), precision and recall over samples."""
    agg = df.agg(
        F.count("*").alias("samples"),
        F.count_if(expected & observed).alias("hits"),
        F.count_if(expected & observed & (expected_count == observed_count)).alias("full"),
        F.count_if(~expected & observed).alias("fp"),
        F.count_if(expected & ~observed).alias("fn"),
    )
    return rates(agg.withColumn("tp", F.col("hits"))).drop("tp")


def offset_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median, P90 and P95 of |value|; the last two by nearest rank, not interpolated."""
    x = F.abs(F.col(value))
    ranks = percentiles(df, keys, x, {"median": (0.5, True), "p90": (0.9, False), "p95": (0.95, False)}).drop("n")
    means = df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.count("*").alias("n"))
    both = means.join(ranks, list(keys)) if keys else means.join(ranks)
    return both.select(*keys, "mean", "median", "p90", "p95", "n")


def transition_counts(df: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str) -> DataFrame:
    """Rows of each kind but the first of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter("_n > 1").groupBy(*keys, kind).agg(F.count("*").alias("n"))


def recent_reuse(df: DataFrame, keys: Sequence[str], order: Sequence[str], source: str, environment: str, back: int) -> DataFrame:
    """(keys, reused, consecutive): rows whose source is among the `back` rows before, and whose environment is the last one's."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = F.array_contains(F.collect_list(source).over(w.rowsBetween(-back, -1)), F.col(source))
    same = F.col(environment) == F.lag(environment).over(w)
    marked = df.withColumn("_r", seen).withColumn("_c", F.coalesce(same, F.lit(False)))
    return marked.groupBy(*keys).agg(F.count_if("_r").alias("reused"), F.count_if("_c").alias("consecutive"))


def compare(left: DataFrame, right: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, v1, v2, delta, available) of two one-row tables; a metric that one lacks is kept, without a delta."""

    def long(df: DataFrame, out: str) -> DataFrame:
        have = [m for m in metrics if m in df.columns]
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(out)) for m in have])
        return df.select(F.explode(pairs).alias("e")).select("e.*")

    both = long(left, "v1").join(long(right, "v2"), "metric", "full_outer")
    return both.withColumn("delta", F.col("v2") - F.col("v1")).withColumn("available", F.col("v1").isNotNull() & F.col("v2").isNotNull())


def rollup(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str]) -> DataFrame:
    """Counts of each of a fixed list of kinds per key, zero-filled, and their total."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds], F.count("*").alias("total"))


def short_intervals(df: DataFrame, keys: Sequence[str], t: str, limits: Mapping[str, float]) -> DataFrame:
    """Per key, intervals between neighbours under each limit, and the least interval."""
    gaps = df.withColumn("_d", F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t)))
    return gaps.groupBy(*keys).agg(*[F.count_if(F.col("_d") < v).alias(k) for k, v in limits.items()], F.min("_d").alias("least"))


