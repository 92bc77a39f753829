"""Reports: the numbers of an edit, gold metrics, boundaries, impacts, and documents made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .intervals import points_within
from .metrics import greedy_match, rates

#: The numbers of an edit that are compared between two of them.
EDIT_METRICS = (
    "macro_shot_count", "average_shot_duration", "median_shot_duration", "unique_source_count", "hero_shot_count", "payoff_anchor_count", "strong_anchor_count",
    "event_sync_mean", "event_sync_median", "event_sync_P90", "event_sync_P95", "cut_sync_mean", "cut_sync_median", "cut_sync_P90", "cut_sync_P95",
    "transition_compatibility_mean", "same_environment_consecutive_count", "same_source_recent_penalty_count", "verified_kill_count", "verified_kill_shot_count", "verified_kill_density_per_10s",
)


def edit_metrics(shots: DataFrame, keys: Sequence[str], back: int = 2) -> DataFrame:
    """One row per edit with EDIT_METRICS. Shots have ord, duration, source, environment, anchor_type, anchor_strength,
    event_sync, cut_sync, compatibility, verified."""
    w = Window.partitionBy(*keys).orderBy("ord")
    recent = F.array_contains(F.collect_list("source").over(w.rowsBetween(-max(1, back), -1)), F.col("source"))
    same = (F.col("environment") != "") & (F.col("environment") == F.lag("environment").over(w))
    s = shots.withColumn("_recent", F.coalesce(recent & (F.col("source") != ""), F.lit(False))).withColumn("_same", F.coalesce(same, F.lit(False)))

    def stats(column: str, name: str) -> list:
        x = F.abs(F.col(column))
        disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY abs({column}))")
        return [F.avg(x).alias(f"{name}_mean"), F.percentile(x, 0.5).alias(f"{name}_median"), disc(0.9).alias(f"{name}_P90"), disc(0.95).alias(f"{name}_P95")]

    return s.groupBy(*keys).agg(
        F.count("*").alias("macro_shot_count"),
        F.avg("duration").alias("average_shot_duration"),
        F.percentile("duration", 0.5).alias("median_shot_duration"),
        F.countDistinct("source").alias("unique_source_count"),
        F.count_if(F.lower(F.coalesce("anchor_type", F.lit(""))).isin("hero", "hero_play")).alias("hero_shot_count"),
        F.count("anchor_strength").alias("payoff_anchor_count"),
        F.count_if(F.col("anchor_strength") >= 0.75).alias("strong_anchor_count"),
        *stats("event_sync", "event_sync"),
        *stats("cut_sync", "cut_sync"),
        F.avg("compatibility").alias("transition_compatibility_mean"),
        F.count_if("_same").alias("same_environment_consecutive_count"),
        F.count_if("_recent").alias("same_source_recent_penalty_count"),
        F.sum("verified").cast("long").alias("verified_kill_count"),
        F.count_if(F.col("verified") > 0).alias("verified_kill_shot_count"),
        (F.sum("verified") / F.greatest(F.lit(0.001), F.sum("duration")) * 10).alias("verified_kill_density_per_10s"),
    )


def penalty_ratios(variants: DataFrame, names: Sequence[str] = ("stationary_ads", "downtime", "repetitive_fire")) -> DataFrame:
    """One row: the mean of each penalty over variants (columns ``..._penalty``), 0 without any."""
    return variants.agg(*[F.coalesce(F.avg(f"{n}_penalty"), F.lit(0.0)).alias(f"{n}_ratio") for n in names])


def document(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """(keys, report): each row as JSON, with the version of the report's shape."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(F.lit(version).alias("report_version"), *rest)).alias("report"))


def markdown(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ord, line): a readable table of a row's numbers, a line each."""
    rest = [c for c in df.columns if c not in keys]
    lines = F.array(*[F.concat(F.lit(f"| {c} | "), F.coalesce(F.col(c).cast("string"), F.lit("unavailable")), F.lit(" |")) for c in rest])
    return df.select(*keys, F.posexplode(lines).alias("ord", "line"))


def gold_metrics(detected: DataFrame, truth: DataFrame, key: str, t: str, tolerance: float, segments: DataFrame | None = None, pooled: bool = False) -> DataFrame:
    """(key, tp, fp, fn, precision, recall) per source, and summed under the key ``ALL``; only detections in labelled segments
    (key, start, end) count, if any are given. `pooled` matches the times of all sources as if they were one."""
    if segments is not None:
        detected = points_within(detected, segments, key, t, 60.0)
    d, g = detected.select(F.col(key).cast("string").alias("key"), t), truth.select(F.col(key).cast("string").alias("key"), t)
    own = greedy_match(d, g, ["key"], t, tolerance)
    if pooled:
        one = F.lit("ALL")
        total = greedy_match(d.withColumn("key", one), g.withColumn("key", one), ["key"], t, tolerance)
    else:
        total = own.agg(F.lit("ALL").alias("key"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return rates(own.unionByName(total))


def boundary(segments: DataFrame, samples: DataFrame, key: str, ids: Sequence[str], edge: str, t: str = "t", reach: float = 0.5) -> DataFrame:
    """(ids, descriptor) of a segment's edge: the means of the channels within `reach`, neutral where there are none.
    Segments may have motion, view, environment and source signatures."""
    s = segments.withColumn("start", F.col(edge) - reach).withColumn("end", F.col(edge) + reach)
    near = points_within(samples.select(key, t, "motion", "brightness", "visual", "audio", "activity"), s.select(key, *ids, "start", "end"), key, t, max(reach * 4, 1.0), "inner")
    m = near.groupBy(*ids).agg(F.avg("motion").alias("_m"), F.avg("brightness").alias("_b"), F.avg("visual").alias("_v"), F.greatest(F.coalesce(F.avg("audio"), F.lit(0.0)), F.coalesce(F.avg("activity"), F.lit(0.0))).alias("_i"), F.count("*").alias("_n"))
    j = segments.join(m, list(ids), "left")
    seen = F.col("_n").isNotNull()
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in segments.columns else F.lit("")
    motion = F.col("variant_motion") if "variant_motion" in segments.columns else F.lit(0.5)
    descriptor = F.struct(
        F.when(seen & (motion >= 0.55), "forward").otherwise("neutral").alias("motion_direction"),
        F.when(seen, F.coalesce("_m", F.lit(0.5))).otherwise(0.5).alias("motion_strength"),
        F.when(seen, F.coalesce("_b", F.lit(0.5))).otherwise(0.5).alias("luminance"),
        F.when(seen, F.coalesce("_v", F.lit(0.5))).otherwise(0.5).alias("visual_tone"),
        F.when(seen, F.coalesce("_m", F.lit(0.5))).otherwise(0.5).alias("weapon_motion"),
        F.when(seen, F.col("_i")).otherwise(0.0).alias("impact_strength"),
        F.when(F.lower(text("view")).isin("ads", "aim", "scoped"), "ads").otherwise("unknown").alias("ads_state"),
        text("environment").alias("environment_signature"),
        text("source").alias("source_signature"),
        F.when(seen, 0.8).otherwise(0.25).alias("confidence"),
    )
    return j.select(*ids, descriptor.alias("descriptor"))


def impact_times(confirmed: DataFrame, evidence: DataFrame, key: str, ids: Sequence[str], t: str = "t", before: float = 0.6, after: float = 0.1, least: float = 0.75) -> DataFrame:
    """(ids, impact): the evidence (key, at, score) nearest to a confirmation within [t - before, t + after], the earlier on a
    tie; null without any."""
    w = confirmed.select(key, *ids, t, (F.col(t) - before).alias("start"), (F.col(t) + after).alias("end"))
    near = points_within(evidence.filter(F.col("score") >= least).select(key, "at"), w, key, "at", max(1.0, before + after), "inner")
    best = near.groupBy(*ids).agg(F.min(F.struct(F.abs(F.col("at") - F.col(t)).alias("d"), F.col("at").alias("impact"))).alias("_b"))
    return confirmed.select(*ids).join(best, list(ids), "left").select(*ids, F.col("_b.impact").alias("impact"))


def music_interval(boundaries: DataFrame, start: float, end: float, most: float, shift: float = 0.5, least: float = 0.70, keys: Sequence[str] = ()) -> DataFrame:
    """One row (music_in, music_out, changed), or one of each key in `boundaries`: an interval whose start or end moves to a boundary (t, confidence, supported)
    that is sure enough and at most `shift` away; of several the surest, then the nearest. Without one it stays."""
    sure = boundaries.filter(F.col("supported") & (F.col("confidence") >= least) & F.col("t").between(0, most))
    sides = F.array(F.struct(F.lit("in").alias("side"), F.lit(float(start)).alias("edge")), F.struct(F.lit("out").alias("side"), F.lit(float(end)).alias("edge")))
    moves = sure.select(*keys, "t", "confidence", F.explode(sides).alias("e")).select(*keys, "t", "confidence", "e.*").filter((F.abs(F.col("t") - F.col("edge")) <= shift) & (F.abs(F.col("t") - F.col("edge")) > 1e-9))
    best = moves.groupBy(*keys).agg(F.max_by(F.struct("side", "t"), F.struct("confidence", -F.abs(F.col("t") - F.col("edge")), F.col("side"))).alias("b"))
    if keys:  # a key without a move stays
        best = boundaries.select(*keys).distinct().join(best, list(keys), "left")
    moved = lambda side, edge: F.when(F.col("b.side") == side, F.col("b.t")).otherwise(F.lit(float(edge)))
    out = best.select(*keys, F.round(moved("in", start), 3).alias("music_in"), F.round(moved("out", end), 3).alias("music_out"), F.col("b").isNotNull().alias("changed"))
    return out.withColumn("changed", F.col("changed") & (F.col("music_out") > F.col("music_in")))


def shots(placed: DataFrame, variants: DataFrame, keys: Sequence[str], music_in: float = 0.0) -> DataFrame:
    """An edit's rows (ord, variant_id, timeline_in, timeline_out) with what their variants say: the anchor on the edit's
    clock, the target in the music and how far off event and cut are. Anchored shots keep their context as 1."""
    v = variants.select("variant_id", "source_in", "source_out", "anchor_t", "anchor_type", "target", "context")
    j = placed.join(v, "variant_id")
    hint = F.lit(music_in) + F.col("timeline_in")
    target = F.when(F.col("anchor_t").isNotNull(), F.coalesce("target", hint)).otherwise(hint)
    at = F.col("timeline_in") + F.least(F.col("source_out") - F.col("source_in"), F.greatest(F.lit(0.0), F.col("anchor_t") - F.col("source_in")))
    return j.select(
        *keys, "ord", "variant_id", "source_in", "source_out", "timeline_in", "timeline_out", "anchor_type", at.alias("event_timeline"), target.alias("music_target"),
        F.round(target - hint, 6).alias("event_sync"), (target - hint).alias("cut_sync"), F.when(F.col("anchor_t").isNotNull(), 1.0).otherwise(F.col("context")).alias("context"), F.lit("hard_cut").alias("transition"),
    )


def review_manifest(clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, clip_id, thumbnail_t, file): what a reviewer's page shows of each clip; making the pictures is left to a renderer."""
    middle = F.round((F.col("source_in") + F.col("source_out")) / 2, 3)
    return clips.select(*keys, "clip_id", middle.alias("thumbnail_t"), F.concat("clip_id", F.lit(".jpg")).alias("file"))


def clamp_context(setup: str, tail: str):
    """The lesser of a moment's setup and tail, each clamped."""
    return F.least(S.clamp(setup), S.clamp(tail))


def output_checks(probe: DataFrame, shots: DataFrame, keys: Sequence[str], width: int, height: int, fps: float, seconds: tuple[float, float], least_context: float = 0.70) -> DataFrame:
    """(keys, a column per check, valid) of rendered edits: what a probe says (has_video, has_audio, width, height, fps, duration, decoded:
    whether all of it could be read) and the edit's shots (source_in, source_out, context, duplicate_group)."""
    groups = shots.groupBy(*keys).agg(
        F.bool_and((F.col("source_in") >= 0) & (F.col("source_out") > F.col("source_in"))).alias("ranges"),
        F.bool_and(F.col("context") >= least_context).alias("integrity"),
        (F.count("duplicate_group") == F.count_distinct("duplicate_group")).alias("dedupe"),
    )
    j = probe.join(groups, list(keys), "left")
    checks = {
        "streams": F.col("has_video") & F.col("has_audio"),
        "size": (F.col("width") == width) & (F.col("height") == height),
        "cadence": F.abs(F.col("fps") - fps) <= max(0.5, fps * 0.02),
        "length": F.col("duration").between(*seconds),
        "decoded": F.col("decoded"),
        **{n: F.col(n) for n in ("ranges", "integrity", "dedupe")},
    }
    out = j.select(*keys, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    return out.withColumn("valid", F.forall(F.array(*checks), lambda c: c))


def truth_index(results: DataFrame, records: DataFrame, found: DataFrame, sequences: DataFrame, key: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(envelope, sources): one row of counts with the status of the whole, and a row for each record; the events and sequences themselves
    stay tables of their own. `results` (key, status, profile_id, frames_scanned, dense_frames_scanned, requests, errors) are of
    scanned sources; a record (key, width, height) without one is UNPROFILED."""
    counts = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    numbers = ["frames_scanned", "dense_frames_scanned", "requests", "errors", "events", "sequences"]
    s = records.select(key, "width", "height").join(results, key, "left").join(counts(found, "events"), key, "left").join(counts(sequences, "sequences"), key, "left")
    s = s.withColumn("status", F.coalesce("status", F.lit("UNPROFILED"))).fillna(0, numbers)
    total = s.agg(F.count("*").alias("source_count"), F.count_if(F.col("status") != "UNPROFILED").alias("scanned_source_count"), F.count_if(F.col("status") == "UNPROFILED").alias("unprofiled_source_count"), F.count_if(F.col("status") == "PARTIAL_ERROR").alias("error_source_count"), *[F.coalesce(F.sum(n), F.lit(0)).alias(f"{n[:-1]}_count") for n in ("events", "sequences")])
    status = F.when(F.col("error_source_count") > 0, "PARTIAL_ERROR").when(F.col("unprofiled_source_count") > 0, "PARTIAL_UNPROFILED").otherwise("COMPLETE")
    return total.withColumn("status", status), s


def truth_report(envelope: DataFrame, found: DataFrame, sequences: DataFrame, key: str = "source_id", t: str = "t", gold: bool = False) -> DataFrame:
    """One row: the index's counts, sequences by kind, the least interval between events of a source, and why a run stops:
    sources without a profile, no gold set, or a review."""
    gaps = found.withColumn("_d", F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))).agg(F.min("_d").alias("shortest_interval"))
    kinds = sequences.groupBy("kind").agg(F.count("*").alias("n")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n"))))).alias("sequence_kinds"))
    stop = F.when(F.col("unprofiled_source_count") > 0, "STOP_PENDING_RESOLUTION_PROFILES_AND_GOLD_SET").when(~F.lit(gold), "STOP_PENDING_GOLD_SET").otherwise("STOP_AFTER_V6_TRUTH_REVIEW")
    return envelope.join(gaps).join(kinds).withColumn("stop", stop)


def preview_report(shots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ord, line): the readable report of edits, from their shots (ord, source, source_in, source_out, duration, score,
    duplicate_group, sync, transition): counts, the list of shots, groups, lengths, transitions and distances from the beat."""
    # a half is judged by the scaled number, as SQL's round does: 2.0035 is 2.003 then
    near = lambda c, digits: F.round(F.col(c) * 10.0**digits) / 10.0**digits
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY abs(sync))")
    one = shots.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("duration").alias("sum"), F.avg("duration").alias("mean"), F.min("duration").alias("least"), F.max("duration").alias("most"), (F.avg(F.abs("sync")) * 1000).alias("off"), (p95 * 1000).alias("late"))
    part = lambda section, place, text: F.struct(F.lit(section).alias("s"), F.lit(place).alias("p"), text.alias("line"))
    head = one.select(
        *keys,
        F.explode(
            F.array(
                part(0, 0, F.lit("## Selection")),
                part(0, 1, F.format_string("%d shots, %.3f s.", "n", "sum")),
                part(1, -1, F.lit("## Shots")),
                part(2, -1, F.lit("## Duplicate groups")),
                part(3, 0, F.lit("## Lengths")),
                part(3, 1, F.format_string("Average %.3f s, shortest %.3f s, longest %.3f s.", near("mean", 3), "least", "most")),
                part(4, -1, F.lit("## Transitions")),
                part(5, 0, F.lit("## Beat offsets")),
                part(5, 1, F.format_string("Mean %.2f ms, P95 %.2f ms.", near("off", 2), near("late", 2))),
            )
        ).alias("x"),
    )
    each = shots.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("s"), F.col("ord").cast("int").alias("p"), F.format_string("- %s [%.3f, %.3f] score %.3f", "source", "source_in", "source_out", "score").alias("line")),
                F.struct(F.lit(2).alias("s"), F.col("ord").cast("int").alias("p"), F.concat(F.lit("- "), F.coalesce("duplicate_group", F.lit("none")), F.lit(": "), F.col("source")).alias("line")),
            )
        ).alias("x"),
    )
    cuts = shots.filter("ord > 1").groupBy(*keys, "transition").agg(F.count("*").alias("n"))
    cuts = cuts.withColumn("p", F.row_number().over(Window.partitionBy(*keys).orderBy("transition"))).select(*keys, F.struct(F.lit(4).alias("s"), F.col("p").alias("p"), F.format_string("- %s: %d", "transition", "n").alias("line")).alias("x"))
    rows = head.unionByName(each).unionByName(cuts).select(*keys, "x.*")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("s", "p"))).select(*keys, "ord", "line")
