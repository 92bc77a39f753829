"""Whole projects: the operators composed as the commands of an editor would run them.

Each function takes and returns DataFrames; nothing runs until a caller reads or writes the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import dedupe, events, fsm, intervals, media, metrics, scoring, selection, series
from ..operators.tables import percentiles, written
from ..sources.config import Settings


def candidates(samples: DataFrame, settings: Settings, key: str = "source_id", t: str = "t") -> DataFrame:
    """Activity windows of series (key, t, motion, visual, audio, continuity, activity) as candidates with the means of
    their channels. The threshold is a percentile of each source's own activity."""
    level = percentiles(samples, [key], F.col("activity"), {"_level": (settings.activity_threshold_percentile / 100, True)}).drop("n")
    hot = samples.join(level, key).withColumn("_hot", (F.col("activity") >= F.col("_level")).cast("double"))
    w = series.activity_islands(hot, [key], t, "_hot", 1.0, settings.activity_merge_gap, settings.highlight_min_duration, settings.highlight_max_duration)
    start, end = F.round(F.col("start") * 1000).cast("bigint"), F.round(F.col("end") * 1000).cast("bigint")
    w = w.withColumn("candidate_id", S.content_id("cand", key, start, end))
    inside = intervals.points_within(samples.select(key, t, "motion", "visual", "audio", "continuity", "activity"), w, key, t, settings.highlight_max_duration, "inner")
    means = inside.groupBy("candidate_id").agg(*[F.avg(S.clamp(c)).alias(n) for c, n in (("activity", "combat_intensity"), ("motion", "motion"), ("audio", "audio_activity"), ("visual", "visual_activity"), ("continuity", "continuity"))])
    return w.join(means, "candidate_id").withColumn("duration", F.col("end") - F.col("start"))


def first_edit(cands: DataFrame, similar: DataFrame, settings: Settings, project: Column) -> DataFrame:
    """The older edit: score, group duplicates (pairs a, b of candidate ids), score again with uniqueness, order, fill the time."""
    scored = scoring.score_candidates(cands.withColumn("uniqueness", F.lit(1.0)).withColumn("human_selection_prior", F.when(F.col("duration") <= settings.short_clip_threshold, 0.85).otherwise(0.35)))
    named = dedupe.groups(dedupe.components(scored.select("candidate_id"), similar, "candidate_id"))
    again = scoring.score_candidates(scored.drop("uniqueness").join(named.select(F.col("id").alias("candidate_id"), "duplicate_group", "uniqueness"), "candidate_id"))
    order = scoring.selection_order(F.col("duration") <= settings.short_clip_threshold, F.col("duration") <= settings.preview_preferred_shot_max_duration, "final_score", "continuity", "candidate_id")
    placed = again.withColumn("project", project).withColumn("_place", F.row_number().over(Window.partitionBy("project").orderBy(*order)))
    return selection.greedy_edit(placed, ["project"], ["_place"], "duration", "duplicate_group", settings.preview_max_duration, settings.highlight_min_duration)


def variants(fused: DataFrame, settings: Settings, key: str = "source_id") -> DataFrame:
    """One variant per cluster of events: its range with context, payoff, counts, penalties and score."""
    c = events.clusters(fused, [key], "t", settings.rapid_multikill_window_s, settings.rapid_multikill_min_events)
    context = settings.v5_sequence_context_s
    c = c.withColumn("start", F.round(F.greatest(F.lit(0.0), F.col("first_t") - context), 3)).withColumn("end", F.round(F.col("last_t") + context, 3))
    c = c.withColumn("variant_id", S.content_id("variant", key, F.round(F.col("start") * 1000).cast("bigint"), F.round(F.col("end") * 1000).cast("bigint"))).dropDuplicates(["variant_id"])
    c = c.withColumn("duration", F.round(F.col("end") - F.col("start"), 3))
    width = settings.rapid_multikill_window_s + 2 * context
    inside = intervals.points_within(fused.select(key, "t", F.col("strength").alias("s"), "semantic"), c.select(key, "variant_id", "start", "end"), key, "t", width, "inner")
    stats = inside.groupBy("variant_id").agg(F.max("s").alias("payoff_score"), F.count_if(F.col("semantic") >= settings.v5_min_kill_semantic_confidence).cast("double").alias("verified_kill_count"), F.count("*").cast("double").alias("rapid_kill_count"))
    v = c.join(stats, "variant_id").withColumns(
        {
            "human_selection_prior": F.lit(settings.v2_short_clip_prior),
            "combat_intensity": S.clamp(F.col("strength") / F.col("n")),
            "action_density": S.clamp(F.col("n") / F.greatest(F.col("duration"), F.lit(1.0))),
            "continuity": F.lit(1.0),
            "visual_novelty": F.lit(0.5),
            "motion": F.lit(0.5),
            "audio_activity": F.lit(0.5),
            "danger_score": F.lit(0.0),
            "uniqueness": F.lit(1.0),
            "rapid_score": S.clamp(F.col("n") / max(2, settings.rapid_multikill_min_events)),
        }
    )
    v = scoring.with_penalties(v, {"motion": F.col("motion"), "visual_novelty": F.col("visual_novelty")}, F.col("payoff_score") > 0, settings.penalty_weights)
    quality = settings.v5_profile == "quality"
    return scoring.score_variants(v, bonus=settings.rapid_multikill_bonus_weight, quality=quality, count_weight=settings.v5_kill_count_weight, density_weight=settings.v5_kill_density_weight, target=settings.v5_kill_density_target)


def second_edit(scored: DataFrame, settings: Settings, project: Column, key: str = "source_id", music: selection.Music = selection.Music()) -> DataFrame:
    """The newer edit: variants that overlap in their source are one group, then a beam search per project."""
    pairs = intervals.overlapping_pairs(scored.select(key, "variant_id", "start", "end"), key, "variant_id", 4 * settings.rapid_multikill_window_s)
    named = dedupe.groups(dedupe.components(scored.select("variant_id"), pairs, "variant_id"), "dg-v2-")
    rows = scored.join(named.select(F.col("id").alias("variant_id"), "duplicate_group"), "variant_id").withColumn("project", project)
    rows = rows.select("project", "variant_id", "duration", "final_score", "duplicate_group", F.col(key).cast("string").alias("source"), F.lit(None).cast("string").alias("environment"), "verified_kill_count", "human_selection_prior")
    return selection.beam_edit(rows, ["project"], settings.beam_width, (settings.v2_min_shots, settings.v2_max_shots), (settings.preview_min_duration, settings.preview_max_duration), settings.beam_max_expansions, (settings.recent_source_window, settings.recent_environment_window), tuple(settings.preferred_macro_duration), max(settings.hero_max_duration, settings.preferred_macro_duration[1]), settings.v2_short_clip_max_duration, settings.minimum_context_integrity, settings.v5_min_verified_kills_per_shot, settings.hero_quality_margin, music, settings.anchor_sync_tolerance, dict(settings.beam_weights))


def _events_of(changes: DataFrame, refined: DataFrame, key: str) -> DataFrame:
    """(key, t, after, before, kind): steps and refined events, each time and count once; of several a step comes first, then the lowest."""
    steps = changes.filter("kind = 'event'").select(key, "t", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"), F.lit("OWN_KILL").alias("kind"), F.lit(0).alias("o"))
    both = steps.unionByName(refined.select(key, "t", "before", "after", "kind", F.lit(1).alias("o")))
    return both.groupBy(key, "t", "after").agg(F.min(F.struct("o", "before", "kind")).alias("e")).select(key, "t", "after", "e.before", "e.kind")


def count_truth(states: DataFrame, settings: Settings, key: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(events, sequences) of counted panels: steps seen at once, and jumps looked up in the dense states around them.

    A refined event belongs to the place of its request, not to whatever is open when it is refined."""
    changes = fsm.count_changes(states, [key], "t", "present", "count", settings.v6_panel_disappear_s)
    r = settings.v6_refinement_radius_s
    requests = changes.filter("kind = 'request'").select(key, F.concat_ws(":", key, "event_id").alias("request_id"), "before", "after", (F.col("t") - r).alias("start"), (F.col("t") + r).alias("end"))
    refined = fsm.refine(requests, states.select(key, "t", "present", "count"), [key], "request_id", max(1.0, 2 * r)).join(requests.select("request_id", key), "request_id")
    found = _events_of(changes, refined, key)
    return found, events.sequences(found, [key], "t", 6.0, tie=("after",))


def two_pass_scan(frames: DataFrame, templates: list, settings: Settings, key: str = "source_id", fps: float = 60.0, **detector) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, sequences, counters) of RGB frames (key, t, width, height, pixels) at the dense rate: every nth frame is
    looked at first; where the count jumps, all frames of the window around the jump.

    Frames of the second pass are found by bands of time, so a frame that no window wants is never looked at again. counters has
    frames_scanned and dense_frames_scanned of each source."""
    step = max(1, round(fps / settings.v6_coarse_fps))
    coarse = media.count_states(frames.filter(F.pmod(F.round(F.col("t") * fps).cast("long"), F.lit(step)) == 0), [key], templates, **detector)
    coarse = written(coarse)  # read for changes, and for the counters
    changes = fsm.count_changes(coarse, [key], "t", "present", "count", settings.v6_panel_disappear_s)
    r = settings.v6_refinement_radius_s
    requests = changes.filter("kind = 'request'").select(key, F.concat_ws(":", key, "t").alias("request_id"), "before", "after", F.greatest(F.lit(0.0), F.col("t") - r).alias("start"), (F.col("t") + r).alias("end"))
    wanted = intervals.points_within(frames, requests.select(key, "start", "end"), key, "t", max(1.0, 2 * r))
    dense = written(media.count_states(wanted, [key], templates, **detector))
    refined = fsm.refine(requests, dense.select(key, "t", "present", "count"), [key], "request_id", max(1.0, 2 * r)).join(requests.select("request_id", key), "request_id")
    found = _events_of(changes, refined, key)
    counters = coarse.groupBy(key).agg(F.count("*").alias("frames_scanned")).join(dense.groupBy(key).agg(F.count("*").alias("dense_frames_scanned")), key, "left").fillna(0, ["dense_frames_scanned"])
    return found, events.sequences(found, [key], "t", 6.0, tie=("after",)), counters


def template_scan(frames: DataFrame, templates: list, bounds: tuple[float, float, float, float], threshold: float = 0.65, key: str = "source_id", reference_height: int | None = None, height: int | None = None, release: float = 0.5) -> DataFrame:
    """Events (key, t, score) of RGB frames: where the best match in a region rises to the threshold after at least `release` below it.
    Templates cut from a picture of `reference_height` are brought to frames of `height`."""
    if reference_height and height:
        templates = [media.resampled(t, height / reference_height) for t in templates]
    scores = media.template_scores(frames, [key], templates, bounds)
    return fsm.rising_edges(scores.withColumn("match", F.col("score") >= threshold), [key], "t", "match", release).drop("match")


def truth_summary(found: DataFrame, records: DataFrame, key: str = "source_id") -> DataFrame:
    """Per recording, counts by kind; a recording without events is kept with zeros."""
    r = metrics.rollup(found, [key], "kind", ("OWN_KILL", "SIMULTANEOUS_MULTI_KILL"))
    out = records.select(key).distinct().join(r, key, "left")
    filled = out.fillna(0, ["OWN_KILL", "SIMULTANEOUS_MULTI_KILL", "total"])
    return filled.withColumn("status", F.when(F.col("total") > 0, "EVENTS").otherwise("EMPTY"))


def gate(metrics_row: DataFrame, precision: float = 0.98, recall: float = 0.95) -> bool:
    """Whether a calibration (one row with precision and recall) allows a scan."""
    row = metrics_row.first()
    return bool(row) and row["precision"] >= precision and row["recall"] >= recall


def generate(detections: DataFrame, ledger: DataFrame, pre: float, post: float, merge_gap: float, bridge: float) -> DataFrame:
    """Detections (event_id, source_id, t) of a ledger (source_id, ord, duration) as contiguous clips: windows merged per source,
    bridged, laid end to end in the ledger's order."""
    if bridge > merge_gap:
        raise ValueError("the bridge cannot be longer than the gap that is merged")
    d = detections.join(ledger.select("source_id", F.col("duration").alias("_d")), "source_id")
    w = d.select("source_id", "_d", "event_id", F.greatest(F.lit(0.0), F.col("t") - pre).alias("a"), F.least(F.col("_d"), F.col("t") + post).alias("b"))
    merged = intervals.merge_windows(w, ["source_id"], "a", "b", merge_gap, ids="event_id", tie=["event_id"]).join(ledger, "source_id")
    clips = intervals.timeline(intervals.bridge(merged, ["source_id"], bridge, 0.0, "duration"), ["ord", "start"])
    return clips.select(F.format_string("clip-%04d", "clip_no").alias("clip_id"), "source_id", F.col("start").alias("source_in"), F.col("end").alias("source_out"), "timeline_in", "timeline_out", F.col("event_id").alias("event_ids"))


def project_violations(clips: DataFrame, ledger: DataFrame) -> DataFrame:
    """(clip_id, rule) of clips that are not contiguous from 0, of unknown sources, or beyond them."""
    w = Window.orderBy("timeline_in", "clip_id")  # one project's clips
    c = clips.withColumn("_prev", F.coalesce(F.lag("timeline_out").over(w), F.lit(0.0))).join(ledger.select("source_id", F.col("duration").alias("_d")), "source_id", "left")
    return selection.violations(
        c,
        {
            "contiguous": F.abs(F.col("timeline_in") - F.col("_prev")) <= 1e-9,
            "known_source": F.col("_d").isNotNull(),
            "range": (F.col("source_in") >= 0) & (F.col("source_out") > F.col("source_in")),
            "within": F.col("_d").isNull() | (F.col("source_out") <= F.col("_d") + 1e-9),
        },
        ["clip_id"],
    )


def summary(shots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shots, seconds, longest, mean): the numbers of an edit's report."""
    d = F.col("timeline_out") - F.col("timeline_in")
    return shots.groupBy(*keys).agg(F.count("*").alias("shots"), F.max("timeline_out").alias("seconds"), F.max(d).alias("longest"), F.avg(d).alias("mean"))
