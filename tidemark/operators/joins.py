"""Time joins: nearest sample, nearest within a tolerance by priority, linear interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _around(queries: DataFrame, samples: DataFrame, keys: Sequence[str], q: str, t: str, values: Sequence[str], width: float | None = None) -> DataFrame:
    """Each query with the last sample at or before it and the first at or after it: one union and windows, no range join.

    With a `width` the windows run within bands of time, so that one long key is worked on by many tasks; what a band
    lacks comes from the last and first samples of the other bands, one row each."""
    own = [c for c in queries.columns if c not in keys]
    left = queries.select(*keys, F.col(q).alias("_x"), F.lit(1).alias("_query"), F.struct(*own).alias("_row"))
    right = samples.select(*keys, F.col(t).alias("_x"), F.lit(0).alias("_query"), F.struct(F.col(t).alias("t"), *values).alias("_s"))
    both = left.unionByName(right, allowMissingColumns=True)
    by = list(keys)
    if width is not None:
        both, by = both.withColumn("_band", F.floor(F.col("_x") / width).cast("long")), [*keys, "_band"]
    w = Window.partitionBy(*by)
    before = F.last("_s", ignorenulls=True).over(w.orderBy("_x", "_query").rowsBetween(Window.unboundedPreceding, 0))
    # backwards, as a frame to the end of the partition would be gone through anew for every row
    after = F.last("_s", ignorenulls=True).over(w.orderBy(F.desc("_x"), "_query").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_before", before).withColumn("_after", after).filter("_query = 1")
    if width is not None:
        ends = both.groupBy(*by).agg(F.max_by("_s", F.when(F.col("_query") == 0, F.col("_x"))).alias("_l"), F.min_by("_s", F.when(F.col("_query") == 0, F.col("_x"))).alias("_f"))
        bands = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*by, F.last("_l", ignorenulls=True).over(bands(F.asc("_band"))).alias("_l"), F.last("_f", ignorenulls=True).over(bands(F.desc("_band"))).alias("_f"))
        found = found.join(carried, by).withColumn("_before", F.coalesce("_before", "_l")).withColumn("_after", F.coalesce("_after", "_f"))
    return found.select(*keys, "_row.*", F.col("_before"), F.col("_after"))


def nearest(queries: DataFrame, samples: DataFrame, keys: Sequence[str], q: str, t: str, values: Sequence[str], width: float | None = None) -> DataFrame:
    """Queries with the values of the nearest sample of their keys, the earlier one on a tie; null without samples.
    Of samples at the same time one is taken: give distinct times."""
    f = _around(queries, samples, keys, q, t, values, width)
    db, da = F.col(q) - F.col("_before.t"), F.col("_after.t") - F.col(q)
    use_before = F.col("_after").isNull() | (F.col("_before").isNotNull() & (db <= da))
    pick = F.when(use_before, F.col("_before")).otherwise(F.col("_after"))
    out = f.withColumn("_pick", pick)
    return out.select(*[c for c in queries.columns], F.col("_pick.t").alias("nearest_t"), *[F.col(f"_pick.{v}").alias(v) for v in values])


def interpolate(queries: DataFrame, samples: DataFrame, keys: Sequence[str], q: str, t: str, value: str, out: str, width: float | None = None) -> DataFrame:
    """Linear interpolation of a series at each query; beyond its ends the value of the end."""
    f = _around(queries, samples, keys, q, t, [value], width)
    b, a = F.col("_before"), F.col("_after")
    share = F.when(a["t"] == b["t"], 0.0).otherwise((F.col(q) - b["t"]) / (a["t"] - b["t"]))
    y = F.when(b.isNull(), a[value]).when(a.isNull(), b[value]).otherwise(b[value] + share * (a[value] - b[value]))
    return f.withColumn(out, y).drop("_before", "_after")


def nearest_within(queries: DataFrame, points: DataFrame, keys: Sequence[str], ids: Sequence[str], q: str, t: str, priority: str, reach: float, kind: str) -> DataFrame:
    """(ids, t, kind, offset): the point within `reach`, nearest first and of higher priority on a tie; the query's own time
    and ``none`` where there is none. A band of width `reach` makes it an equi-join."""
    p = points.select(*keys, F.explode(F.array(*[F.floor(F.col(t) / reach).cast("long") + d for d in (-1, 0, 1)])).alias("_g"), F.col(t).alias("_t"), F.col(priority).alias("_p"), F.col(kind).alias("_kind"))
    both = queries.withColumn("_g", F.floor(F.col(q) / reach).cast("long")).join(p, [*keys, "_g"]).filter(F.abs(F.col("_t") - F.col(q)) <= reach)
    best = both.groupBy(*ids).agg(F.min_by(F.struct("_t", "_kind"), F.struct(F.abs(F.col("_t") - F.col(q)), -F.col("_p"), F.col("_t"))).alias("_b"))
    found = queries.join(best, list(ids), "left")
    target = F.coalesce(F.col("_b._t"), F.col(q))
    return found.select(*ids, target.alias("target"), F.coalesce(F.col("_b._kind"), F.lit("none")).alias("kind"), (target - F.col(q)).alias("offset"))


def anchor_targets(anchors: DataFrame, points: DataFrame, ids: Sequence[str], q: str, strong: str, tolerance: float) -> DataFrame:
    """(ids, target, offset) of anchors among the points (t, type, rank) of one track: a strong anchor goes by rank of the type
    first and then distance, another to the nearest beat or onset; further than `tolerance` the hint stays.

    The points of a track are few, so each kind of point is searched by a nearest join, not by pairing."""
    out = []
    of = anchors.withColumn("_all", F.lit(1))
    strong_points = points.filter(F.col("type").isin("phrase", "downbeat", "strong_beat", "bar"))
    top = points.join(strong_points.agg(F.max("rank").alias("rank")), "rank", "left_semi").filter(F.col("type").isin("phrase", "downbeat", "strong_beat", "bar"))
    for is_strong, own in ((True, top), (False, points.filter(F.col("type").isin("beat", "onset")))):
        samples = own.select("t").distinct().withColumn("_all", F.lit(1))
        out.append(nearest(of.filter(F.col(strong) == is_strong), samples, ["_all"], q, "t", [], max(1.0, 16 * tolerance)))
    both = out[0].unionByName(out[1])
    near = F.abs(F.col("nearest_t") - F.col(q)) <= tolerance
    target = F.when(near, F.col("nearest_t")).otherwise(F.col(q))
    return both.select(*ids, target.alias("target"), F.round(target - F.col(q), 6).alias("offset"))
