"""Interval operators: merging, exclusion, containment, overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _running_end(keys, order):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def merge_windows(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: float, ids: str | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """(keys, start, end[, ids]): windows chained while the next starts no later than `gap` after the furthest end so far.
    A gap of 0 merges touching windows."""
    order = [start, *tie]
    reach = F.max(end).over(_running_end(keys, order))
    marked = df.withColumn("_new", F.when(F.col(start) - reach <= gap, 0).otherwise(1))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_g", F.sum("_new").over(w))
    fields = list(dict.fromkeys([*order, *([ids] if ids else [])]))
    kept = [F.array_sort(F.collect_list(F.struct(*fields))).getField(ids).alias(ids)] if ids else []
    return marked.groupBy(*keys, "_g").agg(F.min(start).alias("start"), F.max(end).alias("end"), *kept).drop("_g")


def bridge(df: DataFrame, keys: Sequence[str], span: float, least: Column | float = 0.0, most: Column | str | None = None) -> DataFrame:
    """Widens both sides of every kept gap by half of `span`, not the first start nor the last end of a key; within [least, most]."""
    w = Window.partitionBy(*keys).orderBy("start")
    low = F.lit(float(least)) if not isinstance(least, Column) else least
    a = F.when(F.lag("start").over(w).isNotNull(), F.greatest(low, F.col("start") - span / 2)).otherwise(F.col("start"))
    b = F.when(F.lead("start").over(w).isNotNull(), F.col("end") + span / 2).otherwise(F.col("end"))
    if most is not None:
        b = F.least(F.col(most) if isinstance(most, str) else most, b)
    return df.withColumn("_a", a).withColumn("_b", b).withColumn("start", F.col("_a")).withColumn("end", F.col("_b")).drop("_a", "_b")


def timeline(df: DataFrame, order: Sequence[str], track: Sequence[str] = ()) -> DataFrame:
    """Adds clip_no, timeline_in and timeline_out: clips one after another from 0, along `order`, per track.

    Without a track it is one running sum over all clips: an edit's, whose clips are few."""
    w = Window.partitionBy(*track).orderBy(*order)
    out = F.sum(F.col("end") - F.col("start")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("clip_no", F.row_number().over(w)).withColumn("timeline_out", out).withColumn("timeline_in", F.col("timeline_out") - (F.col("end") - F.col("start")))


def valid_exclusions(df: DataFrame, start: str = "x0", end: str = "x1") -> DataFrame:
    """Rows with finite times, a start from 0 on and a later end."""
    s, e = F.col(start).try_cast("double"), F.col(end).try_cast("double")
    fine = s.isNotNull() & e.isNotNull() & ~F.isnan(s) & ~F.isnan(e) & (F.abs(s) != float("inf")) & (F.abs(e) != float("inf")) & (s >= 0) & (e > s)
    return df.filter(fine).withColumn(start, s).withColumn(end, e)


def banded(df: DataFrame, start: Column, end: Column, width: float, out: str = "_band") -> DataFrame:
    """A row for each band of `width` that [start, end] touches: range joins become equi-joins on the band."""
    return df.withColumn(out, F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long"))))


def excluded_points(points: DataFrame, exclusions: DataFrame, key: str, t: str, width: float, keep: bool = True) -> DataFrame:
    """Points outside (`keep`) or inside every half-open exclusion [x0, x1) of the same key. `width`: a band about as wide as an exclusion."""
    bands = banded(exclusions, F.col("x0"), F.col("x1"), width).select(F.col(key).alias("_k"), "_band", "x0", "x1")
    p = points.withColumn("_pband", F.floor(F.col(t) / width).cast("long"))
    on = (F.col(key) == F.col("_k")) & (F.col("_pband") == F.col("_band")) & (F.col(t) >= F.col("x0")) & (F.col(t) < F.col("x1"))
    return p.join(bands, on, "left_anti" if keep else "left_semi").drop("_pband")


def exclusion_reasons(windows: DataFrame, exclusions: DataFrame, key: str, ids: Sequence[str], width: float) -> DataFrame:
    """(ids, reason): the first exclusion, by `ord`, that a window [start, end) overlaps; windows without one are absent."""
    x = banded(exclusions, F.col("x0"), F.col("x1"), width).select(F.col(key).alias("_k"), "_band", "x0", "x1", "ord", "reason")
    w = banded(windows, F.col("start"), F.col("end"), width, "_wband")
    on = (F.col(key) == F.col("_k")) & (F.col("_wband") == F.col("_band")) & (F.col("end") > F.col("x0")) & (F.col("start") < F.col("x1"))
    return w.join(x, on).groupBy(*ids).agg(F.min_by("reason", "ord").alias("reason"))


def drop_excluded(windows: DataFrame, exclusions: DataFrame, key: str, ids: Sequence[str], width: float) -> DataFrame:
    """Windows that no exclusion of their key overlaps. The number dropped is the difference of the counts."""
    return windows.join(exclusion_reasons(windows, exclusions, key, ids, width), list(ids), "left_anti")


def points_within(points: DataFrame, windows: DataFrame, key: str, t: str, width: float, how: str = "left_semi") -> DataFrame:
    """Points in any closed window [start, end] of their key (`left_semi`), or joined with all such windows (`inner`)."""
    bands = banded(windows, F.col("start"), F.col("end"), width).withColumnRenamed(key, "_k")
    p = points.withColumn("_pband", F.floor(F.col(t) / width).cast("long"))
    on = (F.col(key) == F.col("_k")) & (F.col("_pband") == F.col("_band")) & F.col(t).between(F.col("start"), F.col("end"))
    return p.join(bands, on, how).drop("_pband", "_band", "_k")


def overlapping_pairs(segments: DataFrame, key: str, owner: str, width: float) -> DataFrame:
    """(a, b): owners, a before b, with half-open segments of one key that overlap."""
    s = banded(segments, F.col("start"), F.col("end"), width).select(key, "_band", F.col(owner).alias("o"), "start", "end")
    a, b = s.alias("a"), s.alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._band") == F.col("b._band")) & (F.col("a.o") < F.col("b.o")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    return a.join(b, on).select(F.col("a.o").alias("a"), F.col("b.o").alias("b")).distinct()


def near_pairs(points: DataFrame, key: str, owner: str, t: str, reach: float) -> DataFrame:
    """(a, b): owners, a before b, with points of one key at most `reach` apart."""
    left = points.select(key, F.col(owner).alias("o"), F.col(t).alias("t"), F.floor(F.col(t) / reach).cast("long").alias("g"))
    right = left.withColumn("g", F.explode(F.array(F.col("g") - 1, F.col("g"), F.col("g") + 1)))
    a, b = left.alias("a"), right.alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.o") < F.col("b.o")) & (F.abs(F.col("a.t") - F.col("b.t")) <= reach)
    return a.join(b, on).select(F.col("a.o").alias("a"), F.col("b.o").alias("b")).distinct()


def refinement_windows(points: DataFrame, keys: Sequence[str], t: str, radius: float, least: float, most: float, tie: Sequence[str] = ()) -> DataFrame:
    """The union of [t - r, t + r] cut to [least, most], r clipped to [0.5, 2]; touching windows merge."""
    r = min(2.0, max(0.5, radius))
    w = points.select(*keys, *tie, F.greatest(F.lit(least), F.col(t) - r).alias("start"), F.least(F.lit(most), F.col(t) + r).alias("end")).filter("end > start")
    return merge_windows(w, keys, "start", "end", 0.0, tie=tie)


def region_lookup(points: DataFrame, regions: DataFrame, t: str, width: float, out: str) -> DataFrame:
    """The label of the first region [start, end) by `ord` that holds each point; null outside all."""
    bands = banded(regions, F.col("start"), F.col("end"), width).select("_band", "start", "end", "ord", F.col("label").alias("_label"))
    p = points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_pband", F.floor(F.col(t) / width).cast("long"))
    on = (F.col("_pband") == F.col("_band")) & (F.col(t) >= F.col("start")) & (F.col(t) < F.col("end"))
    return p.join(bands, on, "left").groupBy("_id", *points.columns).agg(F.min_by("_label", "ord").alias(out)).drop("_id")


def best_window(regions: DataFrame, total: float, widths: tuple[float, float], step: float, weights: dict[str, float]) -> DataFrame:
    """(start, end, score): the window of the smaller to the larger width, along a grid, with the most weighted overlap
    with the regions; the earliest of equal ones. Windows and regions of one piece of music are few."""
    spark = regions.sparkSession
    grid = spark.range(int((total - widths[0]) // step) + 1).select((F.col("id") * step).alias("a")).withColumn("b", F.least(F.lit(total), F.col("a") + widths[1])).filter(F.col("b") - F.col("a") >= widths[0])
    weight = F.coalesce(F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col("energy")), F.lit(0.0))
    share = F.greatest(F.lit(0.0), F.least("b", "end") - F.greatest("a", "start")) * weight
    on = (F.col("a") < F.col("end")) & (F.col("start") < F.col("b"))
    scored = grid.join(regions, on).groupBy("a", "b").agg(F.sum(share).alias("score"))
    return scored.orderBy(F.desc("score"), "a").limit(1).select(F.col("a").alias("start"), F.col("b").alias("end"), "score")
