"""Operators over series: per key, in order of a clock. Window functions only; sorts spill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import percentiles


def over(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def first_difference(df: DataFrame, keys, order, value: str, out: str = "diff") -> DataFrame:
    """value minus the one before; 0 for the first."""
    return df.withColumn(out, F.coalesce(F.col(value) - F.lag(value).over(over(keys, order)), F.lit(0.0)))


def box_smooth(df: DataFrame, keys, order, value: str, width: int, out: str = "smooth") -> DataFrame:
    """Centred moving sum over `width`, divided by `width` also at the ends (where zeros are taken to stand)."""
    frame = over(keys, order).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn(out, F.sum(value).over(frame) / F.lit(float(width)))


def min_max(df: DataFrame, keys, value: str, out: str = "norm") -> DataFrame:
    """(x - min) / (max - min) per key; a constant series is 0."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") - F.col("_lo") <= 1e-12, 0.0).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.join(ends, list(keys)).withColumn(out, scaled).drop("_lo", "_hi")


def robust_normalise(df: DataFrame, keys, value: str, out: str = "norm", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Between the 5th and 95th percentile, clamped; falls back to min and max, then to 0."""
    ends = percentiles(df, keys, F.col(value), {"_lo": (0.0, False), "_p": (low, True), "_q": (high, True), "_hi": (1.0, False)}).drop("n")
    use = F.col("_q") - F.col("_p") > 1e-12
    a, b = F.when(use, F.col("_p")).otherwise(F.col("_lo")), F.when(use, F.col("_q")).otherwise(F.col("_hi"))
    x = (F.col(value) - a) / (b - a)
    return df.join(ends, list(keys), "left").withColumn(out, F.when(b - a <= 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))).drop("_p", "_q", "_lo", "_hi")


def local_peaks(df: DataFrame, keys, order, value: str) -> DataFrame:
    """Rows not below the one before and above the one after; the last of a plateau wins, ends are open."""
    w, least = over(keys, order), F.lit(float("-inf"))
    marked = df.withColumn("_b", F.coalesce(F.lag(value).over(w), least)).withColumn("_a", F.coalesce(F.lead(value).over(w), least))
    return marked.filter((F.col(value) >= F.col("_b")) & (F.col(value) > F.col("_a"))).drop("_b", "_a")


def longest_runs(df: DataFrame, keys, order, masks: dict[str, Column]) -> DataFrame:
    """Per key, the longest run of each mask as a share of the rows."""
    w = over(keys, order)
    out = df
    for name, mask in masks.items():
        out = out.withColumn(f"_{name}", F.coalesce(mask, F.lit(False)))
    out = out.withColumn("_n", F.row_number().over(w))
    for name in masks:
        # the run of a row is named by the last row before it at which the mask is off
        out = out.withColumn(f"_{name}_off", F.coalesce(F.max(F.when(~F.col(f"_{name}"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    lengths = [F.max(F.when(F.col(f"_{n}"), F.col("_n") - F.col(f"_{n}_off")).otherwise(0)).alias(f"_{n}") for n in masks]
    return out.groupBy(*keys).agg(*lengths, F.count("*").alias("_rows")).select(*keys, *[F.round(F.col(f"_{n}") / F.col("_rows"), 6).alias(n) for n in masks])


def activity_islands(df: DataFrame, keys, t: str, value: str, threshold: float, gap: float, low: float, high: float, order: Sequence[str] = ()) -> DataFrame:
    """(keys, start, end): rows of at least `threshold` chained over gaps of up to gap + step, padded by two steps at the
    end, cut into pieces of `high`; pieces under `low` go. The step is the median positive distance of the clock."""
    w = over(keys, [t, *order])
    steps = df.withColumn("_d", F.col(t) - F.lag(t).over(w))
    step = percentiles(steps, keys, F.when(F.col("_d") > 0, F.col("_d")), {"_step": (0.5, True)}).drop("n")
    active = df.filter(F.col(value) >= threshold).join(step, list(keys), "left").fillna(1.0, ["_step"])
    far = F.col(t) - F.lag(t).over(w) > F.lit(gap) + F.col("_step")
    marked = active.withColumn("_new", F.when(F.coalesce(far, F.lit(True)), 1).otherwise(0))
    groups = marked.withColumn("_g", F.sum("_new").over(w)).groupBy(*keys, "_g").agg(F.min(t).alias("_s"), (F.max(t) + 2 * F.first("_step")).alias("_e"))
    many = F.greatest(F.lit(0), F.ceil((F.col("_e") - F.col("_s")) / high - 1e-12).cast("int") - 1)
    pieces = groups.withColumn("_k", F.explode(F.sequence(F.lit(0), many)))
    start = F.col("_s") + F.col("_k") * high
    end = F.least(F.col("_e"), start + high)
    return pieces.select(*keys, start.alias("start"), end.alias("end")).filter(F.col("end") - F.col("start") >= low)


def window_score(series: DataFrame, windows: DataFrame, keys, window_keys, t: str, value: str, high: bool = False, width: float | None = None) -> DataFrame:
    """The mean (or 80th percentile) of a series within each closed window, clamped; of the whole series where no sample lies inside.
    `width`, about that of a window, makes the search an equi-join on bands of time; without it all samples of a key meet all its windows."""
    own = F.percentile(F.col("_v"), 0.8) if high else F.avg("_v")  # of a window's samples
    whole = percentiles(series, keys, F.col(value), {"_all": (0.8, True)}).drop("n") if high else series.groupBy(*keys).agg(F.avg(value).alias("_all"))
    samples, on, w = series.select(*keys, F.col(t).alias("_t"), F.col(value).alias("_v")), list(keys), windows
    if width:
        samples, on = samples.withColumn("_band", F.floor(F.col("_t") / width).cast("long")), [*keys, "_band"]
        w = windows.withColumn("_band", F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long"))))
    inside = w.join(samples, on).filter((F.col("_t") >= F.col("start")) & (F.col("_t") <= F.col("end")))
    found = inside.groupBy(*window_keys).agg(own.alias("_own"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_own", "_all")))
    return windows.join(found, list(window_keys), "left").join(whole, list(keys), "left").withColumn("score", score).drop("_own", "_all")


def trim_edges(df: DataFrame, keys, order, dark: str, limit: float = 0.90) -> DataFrame:
    """Drops the leading and trailing rows whose `dark` is at least `limit`; a key that is dark throughout loses all."""
    w = over(keys, order)
    light = F.col(dark) < limit
    seen = F.max(F.when(light, 1).otherwise(0))
    back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])  # a frame to the end would be gone through anew for every row
    marked = df.withColumn("_before", seen.over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_after", seen.over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("_before = 1 and _after = 1").drop("_before", "_after")


def histogram(df: DataFrame, keys, value: str, bins: int = 4) -> DataFrame:
    """(keys, bucket from 1, n) of values in [0, 1]; 1 belongs to the last bucket. Empty buckets are given as 0."""
    bucket = F.least(F.lit(bins), F.width_bucket(F.col(value), F.lit(0.0), F.lit(1.0), F.lit(bins)).cast("int"))
    counts = df.filter(F.col(value).between(0, 1)).groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = df.select(*keys).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(1), F.lit(bins)))) if keys else df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, [*keys, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def beat_stability(df: DataFrame, keys, t: str) -> DataFrame:
    """1 - 2 std / mean of the intervals between beats, clamped; 0 with fewer than two intervals."""
    gaps = df.withColumn("_d", F.col(t) - F.lag(t).over(over(keys, [t])))
    ratio = 1 - 2 * F.try_divide(F.stddev_pop("_d"), F.avg("_d"))
    return gaps.groupBy(*keys).agg(F.when(F.count("_d") >= 2, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))).otherwise(0.0).alias("stability"))


def every_nth(beats: DataFrame, onsets: DataFrame, keys, t: str, near: float = 0.040) -> DataFrame:
    """(keys, t, type, strength): each fourth beat a bar, each other second a strong beat, the rest beats; and the onsets
    that lie further than `near` from every beat. One row per rounded time and type."""
    n = F.row_number().over(over(keys, [t])) - 1
    kind = F.when(n % 4 == 0, "bar").when(n % 2 == 0, "strong_beat").otherwise("beat")
    rows = beats.select(*keys, F.col(t).alias("t"), kind.alias("type"))
    by = [F.col(f"o.{k}") == F.col(f"b.{k}") for k in keys]
    grid = F.floor(F.col(t) / near).cast("long")
    o = onsets.withColumn("_g", F.explode(F.array(grid - 1, grid, grid + 1))).alias("o")
    close = o.join(beats.withColumn("_g", grid).alias("b"), [*by, F.col("o._g") == F.col("b._g"), F.abs(F.col(f"o.{t}") - F.col(f"b.{t}")) <= near], "left_semi")
    free = onsets.join(close.select(*keys, t).distinct(), [*keys, t], "left_anti").select(*keys, F.col(t).alias("t"), F.lit("onset").alias("type"))
    return rows.unionByName(free).withColumn("t", F.round("t", 3)).dropDuplicates([*keys, "t", "type"])


def energy_regions(df: DataFrame, keys, t: str, value: str, width: float) -> DataFrame:
    """(keys, start, end, energy, role, mean): bins of `width` smoothed over three, labelled low, medium or high by the
    thirds of their distribution, and joined to regions; a medium region before a high one builds up, one after it releases."""
    binned = df.groupBy(*keys, F.floor(F.col(t) / width).cast("long").alias("bin")).agg(F.avg(value).alias("e"))
    w = over(keys, ["bin"])
    smooth = binned.withColumn("e", F.avg("e").over(w.rowsBetween(-1, 1)))
    thirds = smooth.groupBy(*keys).agg(F.percentile("e", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_q"))
    named = smooth.join(thirds, list(keys)).withColumn("energy", F.when(F.col("e") >= F.col("_q")[1], "high").when(F.col("e") <= F.col("_q")[0], "low").otherwise("medium"))
    new = F.coalesce((F.col("energy") != F.lag("energy").over(w)), F.lit(True))
    runs = named.withColumn("_new", new.cast("int")).withColumn("_r", F.sum("_new").over(w))
    regions = runs.groupBy(*keys, "_r").agg(F.first("energy").alias("energy"), (F.min("bin") * width).alias("start"), ((F.max("bin") + 1) * width).alias("end"), F.avg("e").alias("mean"))
    r = over(keys, ["_r"])
    role = F.when(F.col("energy") == "high", "climax").when((F.col("energy") == "medium") & (F.lead("energy").over(r) == "high"), "build_up").when((F.col("energy") == "medium") & (F.lag("energy").over(r) == "high"), "release").when(F.col("energy") == "low", "calm").otherwise("steady")
    return regions.withColumn("role", role).drop("_r")


def fallback_window(df: DataFrame, keys, t: str, value: str, width: float, length: str) -> DataFrame:
    """(keys, start, end): `width` around the highest sample (the earliest of equal ones), inside [0, length]."""
    best = df.groupBy(*keys).agg(F.max_by(t, F.struct(F.col(value), -F.col(t))).alias("_t"), F.max(length).alias("_l"))
    start = F.greatest(F.lit(0.0), F.least(F.col("_t") - width / 2, F.col("_l") - width))
    return best.select(*keys, start.alias("start"), F.least(F.col("_l"), start + width).alias("end"))


def trimmed_range(df: DataFrame, keys, t: str, dark: str, limit: float = 0.90, least: float = 1.0) -> DataFrame:
    """(keys, start, end, trimmed): a candidate's range without dark edges; as it was if less than `least` would be left."""
    whole = df.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"), F.min(F.when(F.col(dark) < limit, F.col(t))).alias("_c"), F.max(F.when(F.col(dark) < limit, F.col(t))).alias("_d"))
    keep = F.coalesce(F.col("_d") - F.col("_c") >= least, F.lit(False))
    return whole.select(*keys, F.when(keep, F.col("_c")).otherwise(F.col("_a")).alias("start"), F.when(keep, F.col("_d")).otherwise(F.col("_b")).alias("end"), keep.alias("trimmed"))
