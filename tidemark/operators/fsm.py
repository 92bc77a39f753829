"""Count machine, refinement of jumps, and debounced edges, in batch; see streaming for the incremental forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_changes(states: DataFrame, keys: Sequence[str], t: str, present: str, count: str, vanish: float) -> DataFrame:
    """Rows of present states at which the count rises within its island: before, after, delta, kind.

    An island of present rows ends when an absent row lies at least `vanish` after the last present one; without an
    observation nothing ends. Only a rise above the island's maximum counts: by one it is an event, by more
    a request to look closer. Falls are ignored."""
    w = Window.partitionBy(*keys).orderBy(t)
    last_present = F.last(F.when(F.col(present), F.col(t)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    closes = (~F.col(present)) & (F.col(t) - last_present >= vanish)
    marked = states.withColumn("_close", F.coalesce(closes, F.lit(False)).cast("int"))
    island = F.sum("_close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = marked.withColumn("island", island).filter(F.col(present))
    inside = Window.partitionBy(*keys, "island").orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(F.lit(0), F.coalesce(F.max(count).over(inside), F.lit(0)))
    out = rows.withColumn("before", before).withColumn("delta", F.col(count) - F.col("before")).filter("delta >= 1")
    return out.withColumn("after", F.col(count)).withColumn("kind", F.when(F.col("delta") == 1, "event").otherwise("request")).drop("_close")


def refine(requests: DataFrame, dense: DataFrame, keys: Sequence[str], request_id: str, width: float | None = None) -> DataFrame:
    """(request_id, t, before, after, kind) of requests (start, end, before, after) looked up in dense states (t, present, count).

    If the rising counts go up by one each to the target, one event a step; else one event of the whole rise at the first
    state that shows the target; without one nothing. `width`, about that of a request, makes the look-up an equi-join on bands of time."""
    own = requests.select(*keys, request_id, F.col("before").alias("_from"), F.col("after").alias("_to"), "start", "end")
    on = list(keys)
    if width:
        own = own.withColumn("_band", F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long"))))
        dense, on = dense.withColumn("_band", F.floor(F.col("t") / width).cast("long")), [*keys, "_band"]
    seen = own.join(dense, on).filter(F.col("present") & F.col("t").between(F.col("start"), F.col("end")))
    w = Window.partitionBy(request_id).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    high = F.greatest(F.col("_from"), F.coalesce(F.max("count").over(w), F.col("_from")))
    rising = seen.withColumn("_high", high)
    summary = rising.groupBy(request_id, "_from", "_to").agg(
        F.min(F.when(F.col("count") == F.col("_to"), F.col("t"))).alias("_target"),
        F.max(F.greatest("_high", "count")).alias("_top"),
        F.max(F.when(F.col("count") > F.col("_high"), F.col("count") - F.col("_high"))).alias("_jump"),
    ).filter(F.col("_target").isNotNull() & (F.col("_to") >= F.col("_from")))
    stepped = (F.col("_top") == F.col("_to")) & (F.coalesce("_jump", F.lit(1)) == 1)
    steps = rising.filter(F.col("count") > F.col("_high")).join(summary.filter(stepped).select(request_id), request_id, "left_semi").select(request_id, "t", F.col("_high").cast("long").alias("before"), F.col("count").cast("long").alias("after"), F.lit("OWN_KILL").alias("kind"))
    whole = summary.filter(~stepped).select(request_id, F.col("_target").alias("t"), F.col("_from").cast("long").alias("before"), F.col("_to").cast("long").alias("after"), F.lit("SIMULTANEOUS_MULTI_KILL").alias("kind"))
    return steps.unionByName(whole)


def rising_edges(df: DataFrame, keys: Sequence[str], t: str, match: str, release: float, tie: Sequence[str] = ()) -> DataFrame:
    """Matching rows that open an event: the first, and those after a miss whose first row lies at least `release` back."""
    w = Window.partitionBy(*keys).orderBy(t, *tie)
    numbered = df.withColumn("_i", F.row_number().over(w)).withColumn("_next", F.lead(t).over(w))
    hits = numbered.filter(F.col(match))
    h = Window.partitionBy(*keys).orderBy("_i")
    apart = (F.col("_i") - F.lag("_i").over(h) > 1) & (F.col(t) - F.lag("_next").over(h) + 1e-6 >= release)
    opened = F.lag("_i").over(h).isNull() | apart
    return hits.withColumn("_opens", opened).filter("_opens").drop("_i", "_next", "_opens")
