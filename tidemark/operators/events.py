"""Event operators: fusing evidence, merging peaks, clusters, anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .streams import sorted_scan


def fuse(samples: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Evidence samples (a column per channel) as events: confidence over families, strength, label, flags. Weak ones go."""
    clamped = samples.withColumns({f"_{c}": F.coalesce(S.clamp(c), F.lit(0.0)) for c in S.FAMILIES})
    own = {c: F.col(f"_{c}") for c in S.FAMILIES}
    e = clamped.withColumn("confidence", S.clamp(S.noisy_or(S.family_maxima(own)))).filter((F.col("confidence") >= threshold) & (F.col("confidence") > 0))
    e = e.withColumn("strength", S.clamp(0.70 * F.col("confidence") + 0.30 * F.greatest(*own.values())))
    e = e.withColumn("_c", S.classify(own, threshold)).withColumn("evidence", S.evidence_map())
    e = e.withColumn("flags", F.array_sort(F.map_keys(F.map_filter("evidence", lambda _, v: v >= threshold))))
    return e.withColumn("type", F.col("_c.type")).withColumn("semantic", F.col("_c.semantic")).drop("_c", *[f"_{c}" for c in S.FAMILIES])


def refractory_groups(df: DataFrame, keys: Sequence[str], t: str, window: float, tie: Sequence[str] = (), out: str = "grp") -> DataFrame:
    """Adds the group of each row: a group ends `window` after its first row, however dense the rows are.

    The bound by the first row can't be had from a fixed frame; rows stream by in order, one number of state per key."""

    def step(state, row_t):
        first, number = state if state else (None, -1)
        if first is None or row_t - first > window + 1e-9:
            first, number = row_t, number + 1
        return (first, number), number

    return sorted_scan(df, keys, [t, *tie], t, step, out)


def merge_peaks(df: DataFrame, keys: Sequence[str], t: str, window: float, label: str = "type", tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """One event per refractory group: the strongest member's id and time, the largest confidence by noisy-or over members,
    the highest ranked label, the number of members."""
    g = refractory_groups(df, keys, t, window, tie)
    order = F.struct("confidence", "strength", "semantic", -F.col(t), -F.col("event_id"))
    return g.groupBy(*keys, "grp").agg(
        F.max_by("event_id", order).alias("event_id"),
        F.max_by(F.col(t), order).alias(t),
        (1 - F.product(1 - S.clamp("confidence"))).alias("confidence"),
        F.max("strength").alias("strength"),
        F.max("semantic").alias("semantic"),
        F.max_by(F.col(label), F.struct(S.label_rank(label), -F.col(t), -F.col("event_id"))).alias(label),
        F.count("*").alias("merged"),
    )


def merge_evidence(df: DataFrame, keys: Sequence[str], evidence: str = "evidence", flags: str = "flags", t: str = "t") -> DataFrame:
    """(keys, evidence, flags): the largest value of each channel, and the flags in the order they first appear."""
    channels = df.select(*keys, F.explode(evidence).alias("c", "v")).groupBy(*keys, "c").agg(F.max(S.clamp("v")).alias("v"))
    maps = channels.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "v")))).alias(evidence))
    named = df.groupBy(*keys).agg(F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct(t, flags))).getField(flags))).alias(flags))
    return named.join(maps, list(keys), "left")


def verified(df: DataFrame, ids: Sequence[str], t: str, semantic: float = 0.80, killfeed: float = 0.25, reward: float = 0.10) -> DataFrame:
    """Corroborated kills, one row per id, the last one by `t`. `df` has type, semantic, killfeed, reward."""
    good = df.filter(F.col("type").isin("kill", "multikill") & (F.col("semantic") >= semantic) & (F.col("killfeed") >= killfeed) & (F.col("reward") >= reward))
    n = F.row_number().over(Window.partitionBy(*ids).orderBy(F.desc(t)))
    return good.withColumn("_n", n).filter("_n = 1").drop("_n")


def _ahead(call: str, keys: Sequence[str], t: str, window: float):
    """An aggregate over rows of the key in [t, t + window]. (A frame over doubles has to be given as SQL.)"""
    by = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} " if keys else ""
    return F.expr(f"{call} OVER ({by}ORDER BY `{t}` RANGE BETWEEN CURRENT ROW AND CAST({window + 1e-9!r} AS DOUBLE) FOLLOWING)")


def window_counts(df: DataFrame, keys: Sequence[str], t: str, window: float) -> DataFrame:
    """Adds n: rows of the key in [t, t + window]."""
    return df.withColumn("n", _ahead("count(*)", keys, t, window))


def rapid_score(df: DataFrame, keys: Sequence[str], t: str, window: float, minimum: int) -> DataFrame:
    """(keys, best, score): the largest count within `window`, and its share of the minimum, cut at 1; below the minimum 0."""
    least = max(2, minimum)
    best = window_counts(df, keys, t, window).groupBy(*keys).agg(F.max("n").alias("best"))
    return best.withColumn("score", F.when(F.col("best") >= least, F.round(S.clamp(F.col("best") / least), 6)).otherwise(0.0))


def clusters(df: DataFrame, keys: Sequence[str], t: str, window: float, minimum: int, strength: str = "strength", tie: str = "event_id") -> DataFrame:
    """A cluster for each event that starts one: n, strength, span, first and last time, id of the first event."""
    over = lambda call: _ahead(call, keys, t, window)
    c = df.select(*keys, F.col(tie).alias("first_id"), F.col(t).alias("first_t"), over("count(*)").alias("n"), over(f"sum(`{strength}`)").alias("strength"), over(f"max(`{t}`)").alias("last_t"))
    return c.filter(F.col("n") >= max(2, minimum)).withColumn("span", F.col("last_t") - F.col("first_t"))


def best_cluster(df: DataFrame, keys: Sequence[str], t: str, window: float, minimum: int) -> DataFrame:
    """Per key the cluster with most events, then more strength (to 9 digits: sums of equal parts may differ in the last bit), then the tighter,
    the one that ends earlier, the larger id."""
    order = F.struct("n", F.round("strength", 9), -F.col("span"), -F.col("last_t"), "first_id")
    best = clusters(df, keys, t, window, minimum).groupBy(*keys).agg(F.max_by(F.struct("first_t", "last_t", "n", "strength", "first_id"), order).alias("b"))
    return best.select(*keys, "b.*")


def apart_clusters(df: DataFrame, keys: Sequence[str], t: str, window: float, minimum: int, context: float, most: int = 6) -> DataFrame:
    """Clusters from the best down that do not overlap one taken before, at most `most` a key, with `context` on both sides.
    The fold's state is the clusters taken so far."""

    def step(state, row):
        taken = state or []
        a, b = row
        fits = len(taken) < most and all(not (a < y and x < b) for x, y in taken)
        return (taken + [(a, b)] if fits else taken), int(fits)

    c = clusters(df, keys, t, window, minimum).withColumn("source_in", F.round(F.greatest(F.lit(0.0), F.col("first_t") - context), 3)).withColumn("source_out", F.round(F.col("last_t") + context, 3))
    ranked = c.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("strength"), F.asc("span"), F.asc("first_t"), F.desc("first_id"))))
    picked = sorted_scan(ranked, keys, ["_rank"], ["source_in", "source_out"], step, "_fits")
    return picked.filter("_fits = 1").drop("_rank", "_fits")


# How much a label counts for an anchor.
IMPORTANCE = {"multikill": 1.0, "vehicle_destroy": 0.95, "kill": 0.85, "objective": 0.8, "combat_climax": 0.65, "danger_climax": 0.6, "impact_event": 0.5, "visual_transient": 0.32}


def anchor_utility(t: str, start: str, end: str, music: str | None = None):
    """How well an event anchors [start, end]: strength, label, place near two thirds, context, nearness to music."""
    length = F.greatest(F.col(end) - F.col(start), F.lit(0.001))
    place = S.clamp((F.col(t) - F.col(start)) / length)
    good_place = S.clamp(1 - F.abs(place - 0.68) / 0.68)
    context = F.least(S.clamp((F.col(t) - F.col(start)) / 2.0), S.clamp(F.col(end) - F.col(t)))
    weight = F.coalesce(F.element_at(F.create_map(*[x for k, v in IMPORTANCE.items() for x in (F.lit(k), F.lit(v))]), F.col("type")), F.lit(0.45))
    near = S.clamp(1 - F.abs(F.col(music))) if music else F.lit(0.0)
    return 0.42 * S.clamp("strength") + 0.24 * weight * F.greatest(F.col("semantic"), F.lit(0.35)) + 0.14 * good_place + 0.10 * near + 0.10 * context


def anchors(df: DataFrame, keys: Sequence[str], t: str, start: str, end: str, weak: float = 0.55, most: int = 3, music: str | None = None) -> DataFrame:
    """The best `most` events of each candidate by utility, later time, larger id; rank 1 is the primary anchor."""
    good = df.filter(F.col(t).between(F.col(start), F.col(end)) & (F.col("confidence") >= weak) & (F.col("strength") >= weak))
    scored = good.withColumn("utility", anchor_utility(t, start, end, music))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("utility"), F.desc(t), F.desc("event_id")))
    return scored.withColumn("rank", n).filter(F.col("rank") <= most)


def sequences(df: DataFrame, keys: Sequence[str], t: str, gap: float, tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """(keys, seq, n, first_t, last_t, kind): runs of events at most `gap` apart, named by their size."""
    w = Window.partitionBy(*keys).orderBy(t, *tie)
    new = F.when(F.col(t) - F.lag(t).over(w) <= gap, 0).otherwise(1)
    g = df.withColumn("_new", new).withColumn("seq", F.sum("_new").over(w))
    out = g.groupBy(*keys, "seq").agg(F.count("*").alias("n"), F.min(t).alias("first_t"), F.max(t).alias("last_t"))
    kind = F.when(F.col("n") == 1, "SINGLE_KILL").when(F.col("n") == 2, "DOUBLE_KILL").when(F.col("n") == 3, "TRIPLE_KILL").when(F.col("n") == 4, "QUAD_KILL").otherwise("MULTI_5_PLUS")
    return out.withColumn("kind", kind)
