"""Operators on small inputs with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import dedupe, events, fsm, intervals, joins, media, metrics, render, reports, scoring, selection, series, sinks
from tidemark.plans import projects
from tidemark.sources import config, media_index, workflow
from tidemark.sources.frames import RawFrames


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def make(spark, data, schema):
    return spark.createDataFrame(data, schema)


# -- series ----------------------------------------------------------------------------------


def test_min_max(spark):
    s = make(spark, [("a", 2.0), ("a", 4.0), ("a", 6.0), ("b", 3.0), ("b", 3.0)], "k string, x double")
    assert rows(series.min_max(s, ["k"], "x"), "k", "norm") == [("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 0.0), ("b", 0.0)]


def test_islands_chain_with_a_step_of_slack(spark):
    s = make(spark, [("s", float(t), 1.0 if t in (5, 6, 8, 9, 10) else 0.0) for t in range(20)], "k string, t double, x double")
    assert rows(series.activity_islands(s, ["k"], "t", "x", 0.8, 3.0, 3.0, 30.0), "start", "end") == [(5.0, 12.0)]


def test_islands_are_cut_and_short_rests_go(spark):
    s = make(spark, [("s", float(t), 1.0) for t in range(12)], "k string, t double, x double")
    assert rows(series.activity_islands(s, ["k"], "t", "x", 0.5, 1.0, 4.0, 5.0), "start", "end") == [(0.0, 5.0), (5.0, 10.0)]


def test_plateaus_keep_their_last_sample(spark):
    s = make(spark, [("s", t, x) for t, x in enumerate([1.0, 3.0, 3.0, 2.0, 2.0, 5.0])], "k string, t int, x double")
    assert rows(series.local_peaks(s, ["k"], ["t"], "x"), "t") == [(2,), (5,)]


def test_box_smooth_is_a_convolution(spark):
    x = np.random.default_rng(0).random(10)
    s = make(spark, [("s", t, float(v)) for t, v in enumerate(x)], "k string, t int, x double")
    for width in (1, 3, 4, 6):
        got = [r["smooth"] for r in series.box_smooth(s, ["k"], ["t"], "x", width).orderBy("t").collect()]
        assert np.allclose(got, np.convolve(x, np.ones(width) / width, "same"))


def test_longest_runs(spark):
    s = make(spark, [("s", t, b) for t, b in enumerate([1, 1, 0, 1, 1, 1, 0, 1])], "k string, t int, b int")
    assert rows(series.longest_runs(s, ["k"], ["t"], {"on": F.col("b") == 1, "none": F.col("b") > 5}), "on", "none") == [(0.375, 0.0)]


def test_window_score_falls_back_to_the_whole_series(spark):
    s = make(spark, [("s", 0.0, 0.2), ("s", 1.0, 0.4)], "k string, t double, x double")
    w = make(spark, [(1, "s", 0.5, 2.0), (2, "s", 7.0, 9.0)], "id int, k string, start double, end double")
    assert [(i, round(v, 9)) for i, v in rows(series.window_score(s, w, ["k"], ["id"], "t", "x"), "id", "score")] == [(1, 0.4), (2, 0.3)]


def test_histogram_folds_one_into_the_last_bin(spark):
    s = make(spark, [(0.0,), (0.25,), (0.9,), (1.0,)], "x double")
    assert rows(series.histogram(s, [], "x"), "bucket", "n") == [(1, 1), (2, 1), (3, 0), (4, 2)]


def test_trim(spark):
    s = make(spark, [("s", t, x) for t, x in enumerate([0.95, 0.99, 0.1, 0.95, 0.2, 0.9])], "k string, t int, x double")
    assert rows(series.trim_edges(s, ["k"], ["t"], "x"), "t") == [(2,), (3,), (4,)]


def test_edit_points(spark):
    beats = make(spark, [("s", t) for t in (0.0, 0.5, 1.0, 1.5, 2.0)], "k string, t double")
    onsets = make(spark, [("s", 0.2), ("s", 0.51), ("s", 1.97)], "k string, t double")
    assert rows(series.every_nth(beats, onsets, ["k"], "t"), "t", "type") == [(0.0, "bar"), (0.2, "onset"), (0.5, "beat"), (1.0, "strong_beat"), (1.5, "beat"), (2.0, "bar")]


def test_energy_regions(spark):
    s = make(spark, [("s", float(t), x) for t, x in enumerate([0.1, 0.1, 0.1, 0.5, 0.5, 0.5, 1.0, 1.0, 1.0])], "k string, t double, x double")
    got = {r["role"] for r in series.energy_regions(s, ["k"], "t", "x", 1.0).collect()}
    assert {"calm", "build_up", "climax"} <= got


# -- intervals -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "times,duration,rule,clips",
    [
        ([("a", 1.0), ("a", 28.0)], 30.0, (3, 4, 2, 0), [("a", 0.0, 5.0, 0.0, 5.0), ("a", 25.0, 30.0, 5.0, 10.0)]),
        ([("a", 1.0), ("a", 5.0), ("a", 7.0)], 20.0, (1, 1, 2, 1), [("a", 0.0, 8.0, 0.0, 8.0)]),
        ([("a", 5.0), ("a", 15.0)], 30.0, (1, 1, 2, 2), [("a", 4.0, 7.0, 0.0, 3.0), ("a", 13.0, 16.0, 3.0, 6.0)]),
        ([("b", 4.0), ("a", 4.0)], 30.0, (1, 1, 2, 0), [("a", 3.0, 5.0, 2.0, 4.0), ("b", 3.0, 5.0, 0.0, 2.0)]),
    ],
)
def test_projects(spark, times, duration, rule, clips):
    d = make(spark, [(f"e{n}", s, t) for n, (s, t) in enumerate(times, 1)], "event_id string, source_id string, t double")
    ledger = make(spark, [("b", 1, duration), ("a", 2, duration)], "source_id string, ord int, duration double")
    out = projects.generate(d, ledger, *map(float, rule))
    assert rows(out, "source_id", "source_in", "source_out", "timeline_in", "timeline_out") == sorted(clips, key=repr)
    assert projects.project_violations(out, ledger).count() == 0
    if len(times) == 3:
        assert out.first()["event_ids"] == ["e1", "e2", "e3"] and out.first()["clip_id"] == "clip-0001"


def test_a_bridge_is_no_longer_than_the_gap(spark):
    with pytest.raises(ValueError):
        projects.generate(None, None, 1, 1, 1, 2)


def test_project_violations(spark):
    clips = make(spark, [("c1", "a", 0.0, 5.0, 0.0, 5.0), ("c2", "a", 25.0, 31.0, 6.0, 12.0), ("c3", "z", 1.0, 0.5, 12.0, 11.5)], "clip_id string, source_id string, source_in double, source_out double, timeline_in double, timeline_out double")
    ledger = make(spark, [("a", 30.0)], "source_id string, duration double")
    assert rows(projects.project_violations(clips, ledger), "clip_id", "rule") == [("c2", "contiguous"), ("c2", "within"), ("c3", "known_source"), ("c3", "range")]


def test_exclusions_are_half_open(spark):
    x = make(spark, [("f", 49.0, 55.0, 1, "menu"), ("f", 50.0, 60.0, 2, "later"), ("f", 5.0, 5.0, 3, "empty"), ("f", -1.0, 5.0, 4, "neg"), ("f", float("nan"), 5.0, 5, "nan")], "k string, x0 double, x1 double, ord int, reason string")
    x = intervals.valid_exclusions(x)
    assert x.count() == 2
    first = x.filter("ord = 1")
    w = make(spark, [(1, "f", 50.0, 52.0), (2, "f", 55.0, 58.0), (3, "f", 48.0, 50.0), (4, "f", 40.0, 49.0), (5, "g", 50.0, 52.0)], "id int, k string, start double, end double")
    assert rows(intervals.drop_excluded(w, first, "k", ["id"], 4.0), "id") == [(2,), (4,), (5,)]
    assert rows(intervals.exclusion_reasons(w, x, "k", ["id"], 4.0), "id", "reason") == [(1, "menu"), (2, "later"), (3, "menu")]
    p = make(spark, [("f", 54.999), ("f", 55.0), ("f", 49.0)], "k string, t double")
    assert rows(intervals.excluded_points(p, first, "k", "t", 4.0), "t") == [(55.0,)]
    assert rows(intervals.excluded_points(p, first, "k", "t", 4.0, keep=False), "t") == [(49.0,), (54.999,)]


def test_touching_windows_merge_and_pairs_do_not_overlap_by_touching(spark):
    w = make(spark, [("s", 1, 0.0, 2.0), ("s", 2, 2.0, 3.0), ("s", 3, 3.5, 4.0)], "k string, id int, start double, end double")
    assert rows(intervals.merge_windows(w, ["k"], "start", "end", 0.0), "start", "end") == [(0.0, 3.0), (3.5, 4.0)]
    assert intervals.overlapping_pairs(w, "k", "id", 1.0).count() == 0
    assert rows(intervals.near_pairs(w.withColumnRenamed("start", "t"), "k", "id", "t", 1.5), "a", "b") == [(2, 3)]


def test_best_window(spark):
    r = make(spark, [(70.0, 105.0, "medium"), (105.0, 150.0, "high")], "start double, end double, energy string")
    w = intervals.best_window(r, 230.0, (45.0, 60.0), 5.0, {"high": 1.0, "medium": 0.4, "low": 0.1}).first()
    assert w["start"] < 105 < w["end"]


# -- joins -----------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [None, 0.7, 3.0])
def test_nearest_and_interpolation(spark, width):
    q = make(spark, [(1, "s", 1.5), (2, "s", -3.0), (3, "s", 9.0), (4, "s", 2.0), (5, "z", 1.0)], "id int, k string, q double")
    v = make(spark, [("s", 1.0, 10.0), ("s", 2.0, 20.0), ("s", 4.0, 0.0)], "k string, t double, v double")
    near = joins.nearest(q, v, ["k"], "q", "t", ["v"], width)
    assert rows(near, "id", "v") == [(1, 10.0), (2, 10.0), (3, 0.0), (4, 20.0), (5, None)]
    assert rows(joins.interpolate(q, v, ["k"], "q", "t", "v", "y", width), "id", "y") == [(1, 15.0), (2, 10.0), (3, 0.0), (4, 20.0), (5, None)]


def test_nearest_within_goes_by_distance_then_priority(spark):
    q = make(spark, [(1, "s", 10.0), (2, "s", 50.0)], "id int, k string, q double")
    p = make(spark, [("s", 9.5, 1, "onset"), ("s", 10.5, 4, "bar"), ("s", 12.0, 9, "phrase")], "k string, t double, pr int, kind string")
    out = joins.nearest_within(q, p, ["k"], ["id"], "q", "t", "pr", 0.75, "kind")
    assert rows(out, "id", "target", "kind", "offset") == [(1, 10.5, "bar", 0.5), (2, 50.0, "none", 0.0)]


def test_strong_anchors_go_by_rank_first(spark):
    p = make(spark, [(10.1, "bar", 3.5), (10.9, "strong_beat", 4.0), (30.0, "strong_beat", 4.0), (10.05, "beat", 2.0)], "t double, type string, rank double")
    a = make(spark, [(1, 10.0, True), (2, 10.0, False), (3, 11.0, True)], "id int, q double, strong boolean")
    assert rows(joins.anchor_targets(a, p, ["id"], "q", "strong", 0.75), "id", "target", "offset") == [(1, 10.0, 0.0), (2, 10.05, 0.05), (3, 10.9, -0.1)]


# -- events ----------------------------------------------------------------------------------


def sample(spark, **channels):
    return make(spark, [tuple(float(channels.get(c, 0.0)) for c in S.FAMILIES)], ", ".join(f"{c} double" for c in S.FAMILIES))


def test_fusion(spark):
    assert events.fuse(sample(spark, motion_peak=0.05)).count() == 0
    lone = events.fuse(sample(spark, killfeed_change=0.95, motion_peak=0.1)).first()
    assert lone["type"] in ("visual_transient", "combat_climax") and lone["semantic"] < 0.55
    many = events.fuse(sample(spark, reward_roi_change=0.81, crosshair_event=0.76, audio_transient=0.91, motion_peak=0.68, killfeed_change=0.44)).first()
    assert many["confidence"] >= 0.75 and len(many["evidence"]) == 5 and many["type"] == "kill"
    threshold = lambda t: events.fuse(sample(spark, killfeed_change=0.6, crosshair_event=0.6), t).first()["type"] == "kill"
    assert threshold(0.35) and not threshold(0.70)


def peaks(spark, data):
    return make(spark, [(n, "s", t, c, c, 0.0, "kill") for n, (t, c) in enumerate(data)], "event_id long, k string, t double, confidence double, strength double, semantic double, type string")


def test_refractory_groups_do_not_chain(spark):
    one_event = events.merge_peaks(peaks(spark, [(10.0, 0.72), (10.55, 0.81)]), ["k"], "t", 0.7)
    assert rows(one_event, "t", "merged") == [(10.55, 2)]
    assert rows(events.merge_peaks(peaks(spark, [(10.0, 0.5), (10.65, 0.5), (11.3, 0.5)]), ["k"], "t", 0.7), "merged") == [(1,), (2,)]
    chained = events.refractory_groups(peaks(spark, [(0.1 * k, 0.5) for k in range(100)]).repartition(3), ["k"], "t", 0.7)
    assert chained.select("grp").distinct().count() == 13


def test_rapid_windows(spark):
    score = lambda *t: events.rapid_score(peaks(spark, [(x, 0.5) for x in t]), ["k"], "t", 4.0, 2).first()["score"]
    assert score(2.0, 5.5, 6.0) == 1.0 and score(2.0, 6.1) == 0.0


def test_clusters(spark):
    e = peaks(spark, [(0.0, 0.1), (1.0, 0.1), (1.5, 0.9), (20.0, 0.5), (21.0, 0.6), (40.0, 0.1)])
    assert rows(events.best_cluster(e, ["k"], "t", 4.0, 2), "first_t", "last_t", "n") == [(0.0, 1.5, 3)]
    assert rows(events.apart_clusters(e, ["k"], "t", 4.0, 2, 1.0), "source_in", "source_out") == [(0.0, 2.5), (19.0, 22.0)]
    assert events.apart_clusters(e, ["k"], "t", 4.0, 2, 1.0, most=1).count() == 1


def test_anchors(spark):
    e = make(spark, [(1, "c", 2.0, 0.0, 12.0, "kill", 0.9, 0.92, 0.92), (2, "c", 8.0, 0.0, 12.0, "multikill", 0.9, 0.84, 0.95), (3, "c", 5.0, 0.0, 12.0, "kill", 0.4, 0.9, 0.9), (4, "c", 20.0, 0.0, 12.0, "kill", 0.9, 0.9, 0.9)], "event_id long, k string, t double, start double, end double, type string, confidence double, strength double, semantic double")
    assert rows(events.anchors(e, ["k"], "t", "start", "end"), "rank", "event_id") == [(1, 2), (2, 1)]


def test_verified_events_count_once(spark):
    e = make(spark, [("a", 1.0, "kill", 0.9, 0.3, 0.2), ("a", 2.0, "kill", 0.9, 0.3, 0.2), ("b", 1.0, "kill", 0.9, 0.2, 0.2), ("c", 1.0, "objective", 0.9, 0.9, 0.9)], "event_id string, t double, type string, semantic double, killfeed double, reward double")
    assert rows(events.verified(e, ["event_id"], "t"), "event_id", "t") == [("a", 2.0)]


def panel(spark, data):
    return make(spark, [("s", n, t, c is not None, c or 0) for n, (t, c) in enumerate(data)], "k string, event_id int, t double, present boolean, count int")


@pytest.mark.parametrize(
    "data,vanish,changes",
    [
        ([(1.0, 1), (1.067, 1), (1.133, 1), (1.2, 1)], 0.75, [(0, 1, "event")]),
        ([(9.0, 1), (9.2, 2), (10.0, 3), (10.3, 4)], 0.75, [(0, 1, "event"), (1, 2, "event"), (2, 3, "event"), (3, 4, "event")]),
        ([(1.0, 1), (1.1, None), (1.2, 1), (1.3, 2)], 0.6, [(0, 1, "event"), (1, 2, "event")]),
        ([(2.0, 1), (2.2, None), (2.7, None), (3.0, 1)], 0.5, [(0, 1, "event"), (0, 1, "event")]),
        ([(1.0, 2), (1.5, 1), (2.0, 4)], 0.75, [(0, 2, "request"), (2, 4, "request")]),
        ([(1.0, 1), (9.0, 2)], 0.5, [(0, 1, "event"), (1, 2, "event")]),
    ],
)
def test_count_machine(spark, data, vanish, changes):
    assert rows(fsm.count_changes(panel(spark, data), ["k"], "t", "present", "count", vanish), "before", "after", "kind") == changes


@pytest.mark.parametrize("dense,found", [([2, 3, 4], [(2, 3, "OWN_KILL"), (3, 4, "OWN_KILL")]), ([4], [(2, 4, "SIMULTANEOUS_MULTI_KILL")]), ([2, 3], []), ([2, 4, 3], [(2, 4, "SIMULTANEOUS_MULTI_KILL")])])
def test_refinement(spark, dense, found):
    r = make(spark, [("s", "r", 2, 4, 7.0, 9.0)], "k string, id string, before int, after int, start double, end double")
    d = panel(spark, [(8.0 + 0.05 * n, c) for n, c in enumerate(dense)]).select("k", "t", "present", "count")
    assert rows(fsm.refine(r, d, ["k"], "id"), "before", "after", "kind") == found


def test_edges_are_measured_from_the_first_miss(spark):
    data = [(0.0, 1), (0.05, 0), (0.14, 1), (0.2, 0), (0.25, 0), (0.31, 1), (0.5, 1)]
    e = make(spark, [("s", t, bool(h)) for t, h in data], "k string, t double, hit boolean")
    assert rows(fsm.rising_edges(e, ["k"], "t", "hit", 0.10), "t") == [(0.0,), (0.31,)]


# -- fingerprints ----------------------------------------------------------------------------


def test_hashes(spark):
    grid = np.random.default_rng(1).random((8, 8))
    bits = "".join("1" if a > b else "0" for r in grid for a, b in zip(r, r[1:]))
    assert one(spark, S.dhash(F.array(*map(F.lit, grid.ravel().tolist())))) == int(bits, 2)
    assert media.block_means(np.repeat(np.repeat(grid, 4, 0), 4, 1)).reshape(8, 8) == pytest.approx(grid)
    like = lambda a, b: one(spark, S.sequence_similarity(F.array(*[F.lit(x).cast("bigint") for x in a]) if a else F.expr("cast(array() as array<bigint>)"), F.array(*[F.lit(x).cast("bigint") for x in b])))
    assert like([3, 4], [3, 4]) == 1.0 and like([3], [0, 3, 7]) == 1.0 and like([], [1]) == 0.0 and like([0], [2**56 - 1]) == 0.0


def test_pairs_components_and_groups(spark):
    rng = np.random.default_rng(0)
    h = [(i, int(x)) for i, x in enumerate(rng.integers(0, 2**56, 60))] + [(100, 7), (101, 7), (102, 5), (103, 2**56 - 1)]
    found = dedupe.similar_pairs(make(spark, h, "id long, h long"), "id", "h", 0.7)
    want = sorted((a, b, 1 - bin(x ^ y).count("1") / 56) for a, x in h for b, y in h if a < b and 1 - bin(x ^ y).count("1") / 56 >= 0.7)
    assert rows(found, "a", "b", "similarity") == sorted(want, key=repr)
    nodes, edges = make(spark, [(i,) for i in range(30)], "id long"), make(spark, [(i, i + 1) for i in range(0, 18)] + [(25, 22)], "a long, b long")
    g = dedupe.groups(dedupe.components(nodes, edges))
    assert {r["component"] for r in g.filter("id <= 18").collect()} == {0} and g.select("duplicate_group").distinct().count() == 11
    assert rows(g.filter("id in (22, 25)"), "component", "uniqueness") == [(22, 0.5), (22, 0.5)] and g.filter("id = 0").first()["duplicate_group"] == "dg-001"


def test_forced_reasons_by_priority(spark):
    flags = make(spark, [(1, True, True, True, True, True), (2, True, False, True, True, True), (3, False, True, True, True, True), (4, False, True, False, True, True), (5, False, False, False, True, True), (6, False, False, False, False, True)], "id int, strict boolean, overlap boolean, near boolean, parent boolean, events boolean")
    out = flags.withColumn("r", dedupe.forced_reason(F.col("strict"), F.col("overlap"), F.col("near"), F.col("parent"), F.col("overlap"), F.col("events")))
    assert rows(out, "id", "r") == [(1, "same_source_overlap"), (2, "same_source_event_window_overlap"), (3, "same_parent_source_overlap"), (4, "same_parent_source_overlap"), (5, "same_parent_event_window_overlap"), (6, None)]


def test_fast_representatives_look_at_counts_only_where_there_are_any(spark):
    schema = "g string, id string, verified_kill_count double, kill_density double, human_selection_prior double, payoff_score double, context_integrity double, final_score double, duration double"
    v = make(spark, [("a", "x", 1.0, 0.1, 0.9, 0.5, 1.0, 0.5, 6.0), ("a", "y", 3.0, 0.1, 0.1, 0.5, 1.0, 0.5, 6.0), ("b", "x", None, None, 0.9, 0.5, 1.0, 0.5, 6.0), ("b", "y", None, None, 0.1, 0.5, 1.0, 0.5, 9.0)], schema)
    marked, order = dedupe.fast_order(v, "g")
    assert rows(dedupe.representatives(marked, "g", "id", order, "fast"), "g", "fast") == [("a", "y"), ("b", "x")]
    assert rows(dedupe.representatives(v, "g", "id", dedupe.full_order(), "full"), "g", "full") == [("a", "x"), ("b", "y")]


# -- scoring, selection, metrics ---------------------------------------------------------------


def test_scores_and_curves(spark):
    assert one(spark, S.clamp(F.lit(None).cast("double"))) is None and one(spark, S.clamp(F.lit(7.0))) == 1.0
    assert one(spark, scoring.energy_target(F.lit(0.0))) == pytest.approx(0.30) and one(spark, scoring.energy_target(F.lit(0.525))) == pytest.approx(0.75)
    assert one(spark, S.section(F.lit(50.0), F.lit(100.0))) == "release"
    p = scoring.penalties(F.create_map(F.lit("downtime"), F.lit(1.0)), F.lit(True))
    assert one(spark, p["downtime_penalty"]) == pytest.approx(0.35) and one(spark, p["no_payoff_penalty"]) == 0.0


@pytest.mark.parametrize("d,kind,reason,integrity,saved,ok", [(6.0, "kill", "", 1.0, False, True), (1.5, "kill", "", 1.0, False, False), (11.0, "kill", "", 1.0, False, False), (11.0, "hero", "", 1.0, False, True), (11.0, "kill", "bar_boundary", 0.8, False, True), (11.0, "kill", "bar_boundary", 0.5, False, False), (25.0, "kill", "", 1.0, True, True), (31.0, "kill", "", 1.0, True, False)])
def test_durations(spark, d, kind, reason, integrity, saved, ok):
    assert one(spark, S.duration_allowed(F.lit(d), F.lit(kind), F.lit(reason), F.lit(integrity), preserved=F.lit(saved))) is ok


def test_audio_overlaps(spark):
    mode = lambda c, impact, j, l: tuple(one(spark, S.audio_overlap(F.lit(c), F.lit(impact), F.lit(j), F.lit(l))))
    assert mode(0.65, False, 0, 0) == ("direct", 0) and mode(0.9, True, 0, 0) == ("direct", 0)
    assert mode(0.9, False, 0, 0) == ("j_cut", 100) and mode(0.9, False, 0, 400) == ("l_cut", 250)


def test_greedy_edit(spark):
    c = make(spark, [("p", 1, 1, 30.0, "a"), ("p", 2, 2, 20.0, "a"), ("p", 3, 3, 25.0, "b"), ("p", 4, 4, 50.0, "c"), ("p", 5, 5, 9.0, "d")], "k string, id int, o int, d double, g string")
    assert rows(selection.greedy_edit(c, ["k"], ["o"], "d", "g", 60.0), "id", "timeline_in", "used") == [(1, 0.0, 30.0), (3, 30.0, 25.0), (4, 55.0, 5.0)]


def test_beam_edit_keeps_its_rules(spark):
    v = [("p", f"v{n:02d}", 5.0 + n % 5, 1 - n / 50, f"g{n % 15}", f"s{n % 4}", "e") for n in range(30)]
    out = selection.beam_edit(make(spark, v, "project string, variant_id string, duration double, final_score double, duplicate_group string, source string, environment string"), ["project"])
    shots = sorted(out.collect(), key=lambda r: r["ord"])
    groups = [int(r["variant_id"][1:]) % 15 for r in shots]
    assert 8 <= len(shots) <= 14 and len(set(groups)) == len(groups) and 45 <= shots[-1]["timeline_out"] <= 60 + 1e-6
    assert all(abs(a["timeline_out"] - b["timeline_in"]) < 1e-9 for a, b in zip(shots, shots[1:])) and shots[-1]["section"] == "finale"
    named = out.join(make(spark, [(x[1], x[4]) for x in v], "variant_id string, duplicate_group string"), "variant_id").withColumn("duration", F.col("timeline_out") - F.col("timeline_in")).withColumn("transition", F.lit("hard_cut"))
    assert selection.edit_violations(named, ["project"], 45.0, 60.0).count() == 0
    assert selection.beam_edit(make(spark, v[:3], "project string, variant_id string, duration double, final_score double, duplicate_group string, source string, environment string"), ["project"]).count() == 0


def test_edit_violations(spark):
    s = make(spark, [("p", 1, 0.0, 21.0, 21.0, "a", "hard_cut"), ("p", 2, 21.0, 42.0, 21.0, "a", "hard_cut"), ("p", 3, 42.0, 63.0, 21.0, "b", "fade"), ("p", 4, 64.0, 70.0, 6.0, "c", "hard_cut")], "k string, ord int, timeline_in double, timeline_out double, duration double, duplicate_group string, transition string")
    assert rows(selection.edit_violations(s, ["k"], 45.0, 60.0), "rule", "n") == [("contiguous", 1), ("hard_cut", 1), ("long_run", 1), ("total", 1), ("unique_group", 2)]


def test_matching_is_greedy_in_time(spark):
    d, g = make(spark, [("s", 1.0), ("s", 2.0), ("s", 2.4), ("z", 5.0)], "k string, t double"), make(spark, [("s", 1.2), ("s", 3.0), ("y", 1.0)], "k string, t double")
    assert rows(metrics.greedy_match(d, g, ["k"], "t", 0.25), "k", "tp", "fp", "fn") == [("s", 1, 2, 1), ("y", 0, 0, 1), ("z", 0, 1, 0)]


def test_matching_equals_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    d, g = [[("s", float(x)) for x in np.unique(rng.integers(0, 400, 120)) / 10] for _ in range(2)]
    free, tp = sorted(t for _, t in g), 0
    for _, t in sorted(d):
        near = min((x for x in free if abs(x - t) <= 0.35), key=lambda x: (abs(x - t), x), default=None)
        if near is not None:
            free.remove(near)
            tp += 1
    out = metrics.greedy_match(make(spark, d, "k string, t double"), make(spark, g, "k string, t double"), ["k"], "t", 0.35).first()
    assert (out["tp"], out["fp"], out["fn"]) == (tp, len(d) - tp, len(g) - tp)


def test_calibration(spark):
    c = make(spark, [(True, True, 1, 1), (True, True, 2, 3), (False, False, 0, 0), (False, True, 0, 1)], "e boolean, o boolean, ec int, oc int")
    r = metrics.calibration(c, F.col("e"), F.col("o"), F.col("ec"), F.col("oc")).first()
    assert (r["hits"], r["full"], round(r["precision"], 4), r["recall"]) == (2, 1, 0.6667, 1.0)
    assert not projects.gate(spark.createDataFrame([r])) and projects.gate(make(spark, [(1.0, 1.0)], "precision double, recall double"))


def test_percentiles_are_by_nearest_rank(spark):
    r = metrics.offset_stats(make(spark, [(float(-x),) for x in range(1, 12)], "x double"), [], "x").first()
    assert (r["mean"], r["median"], r["p90"], r["p95"]) == (6.0, 6.0, 10.0, 11.0)


def test_suppression_and_rows(spark):
    b = make(spark, [("f", 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("f", 2, 0.8, 1.0, 1.0, 11.0, 11.0), ("f", 3, 0.7, 30.0, 0.0, 40.0, 10.0)], "k string, id int, s double, x1 double, y1 double, x2 double, y2 double")
    assert rows(selection.suppress_hits(b, ["k"], "s", "id"), "id") == [(1,), (3,)]
    y = make(spark, [("f", n, v) for n, v in enumerate([10.0, 11.0, 30.0, 12.0, 31.0])], "k string, id int, y double")
    assert rows(selection.row_groups(y, ["k"], "y", 5.0, ["id"]), "y", "row") == [(10.0, 0), (11.0, 0), (12.0, 0), (30.0, 1), (31.0, 1)]


# -- sources and sinks -------------------------------------------------------------------------


def test_settings():
    s = config.settings({"v5_profile": "QUALITY", "template_decode_height": "9999", "v6_coarse_fps": "x", "beam_width": 4.0, "unknown": 1, "v2_excluded_ranges": [{"source_name": "a", "start": 1, "end": 2, "reason": "r"}, {"source_name": "a", "start": 3, "end": 3}, {"source_name": "", "start": 1, "end": 2}, {"source_name": "b", "start": "nan", "end": 2}, 7]})
    assert (s.v5_profile, s.template_decode_height, s.v6_coarse_fps, s.beam_width) == ("quality", 2160, 12.0, 4)
    assert s.v2_excluded_ranges == (config.Exclusion("a", 1.0, 2.0, "r"),)
    assert config.settings({"v5_profile": "other"}).v5_profile == "off"
    q = config.quality_profile(s)
    assert (q.preview_max_duration, q.beam_max_expansions, q.v5_min_verified_kills_per_shot) == (150.0, 65536, 1) and config.long_profile(s).v2_max_shots == 8


def test_settings_file(tmp_path):
    (tmp_path / "c.yaml").write_text("beam_width: 3\nweights: {motion: 0.5}\nvideo_extensions: ['.MP4']\n")
    s = config.load(str(tmp_path / "c.yaml"))
    assert s.beam_width == 3 and s.weights == {"motion": 0.5} and s.video_extensions == (".mp4",)


def test_workflows_in_both_dialects(spark):
    roi = '{"coordinate_space": "normalized", "x1": 0.1, "y1": 0.1, "x2": 0.5, "y2": 0.5}'
    texts = [
        (1, f'{{"schema": "own{workflow.SCHEMA_ENDS}", "detector": {{"detector_type": "skull_row", "event_label": "KILL", "roi": {roi}, "thresholds": {{"a": 0.5}}}}}}'),
        (2, f'{{"schema": "own{workflow.SCHEMA_ENDS}", "rules": [{{"id": "r", "label": "A", "type": "template_match", "roi": {roi}}}, {{"id": "r", "label": "B", "detector": {{"detector_type": "x", "roi": {roi.replace("0.5", "1.5")}}}}}], "edit_rules": {{"merge_gap_seconds": 1.0, "long_gap_bridge_seconds": 2.0}}}}'),
        (3, '{"schema": "other"}'), (4, "no json"),
    ]
    w = workflow.parse(make(spark, texts, "id int, text string"), "text")
    assert rows(workflow.rules(w, "id"), "id", "rule_id", "label", "detector_type") == [(1, "rule-1", "KILL", "skull_row"), (2, "r", "A", "template_match"), (2, "r-2", "B", "x")]
    assert rows(workflow.violations(w, "id"), "id", "rule") == [(2, "bridge"), (2, "roi")]
    again = workflow.parse(workflow.export(w, "id"), "text")
    assert rows(workflow.rules(again, "id"), "id", "rule_id") == [(1, "rule-1"), (2, "r"), (2, "r-2")]


def test_media_listing_and_index(spark, tmp_path):
    for n in ("a.MP4", "sub/b.mkv", "c.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * 3)
    found = media_index.listing(spark, str(tmp_path)).withColumn("fingerprint", media_index.fingerprint())
    assert sorted(r["file_path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.MP4", "b.mkv"]
    valid, fresh = media_index.incremental(found, found.filter(F.col("file_path").endswith("a.MP4")))
    assert (valid.count(), fresh.count()) == (1, 1)
    bad = media_index.probed(make(spark, [("not json",), ('{"streams": [], "format": {}}',)], "probe string"))
    assert {r["error"] for r in bad.collect()} == {"unreadable probe", "no video stream"}
    with pytest.raises(ValueError):
        media_index.select_sources(found, "/elsewhere", ["/other/x.mp4"])


def test_rates(spark):
    r = make(spark, [("60000/1001",), ("30/0",), ("25",), ("x",), ("",)], "f string").withColumn("r", S.parse_rate("f"))
    assert rows(r, "f", "r") == [("", 0.0), ("25", 25.0), ("30/0", 0.0), ("60000/1001", 59.94), ("x", 0.0)]


def test_raw_frames(spark, tmp_path):
    frames = np.arange(10 * 4 * 6, dtype=np.uint8).reshape(10, 4, 6)
    (tmp_path / "f.raw").write_bytes(frames.tobytes())
    spark.dataSource.register(RawFrames)
    load = lambda **o: spark.read.format("raw_frames").options(path=str(tmp_path / "f.raw"), width=6, height=4, fps=2, **o).load()
    assert load(framesPerPartition=3).count() == 10
    part = load(start=1, end=2.5, region="1,1,3,4").orderBy("frame_no").collect()
    assert [r["frame_no"] for r in part] == [2, 3, 4, 5] and bytes(part[0]["pixels"]) == frames[2, 1:4, 1:3].tobytes()
    stats = media.frame_statistics(load().withColumn("k", F.lit("s")), ["k"], ["frame_no"]).orderBy("frame_no").collect()
    assert stats[0]["difference"] == 0.0 and stats[1]["difference"] == pytest.approx(24 / 255) and stats[0]["black_ratio"] == pytest.approx(8 / 24)
    (tmp_path / "f.raw").write_bytes(frames.tobytes()[:-1])
    with pytest.raises(Exception, match="within a frame"):
        load().count()


def test_waveforms_and_templates(spark):
    x = (np.sin(np.arange(4000) / 10) * 0.5).tolist()
    w = media.waveform_features(make(spark, [("s", 2.0, x)], "k string, start_s double, x array<double>"), ["k"], "x", 1000).orderBy("t").collect()
    assert w[0]["t"] == 2.0 and w[0]["flux"] == 0.0 and w[5]["rms"] == pytest.approx(0.354, abs=0.05) and w[5]["peak"] <= 0.5
    frame = np.random.default_rng(0).random((20, 20))
    assert media.template_score(frame, frame[3:9, 4:11]) == pytest.approx(1.0) and media.template_score(frame, np.ones((3, 3))) == 0.0


def test_small_documents_and_caches(spark, tmp_path):
    path = str(tmp_path / "d" / "x.json")
    sinks.write_atomically(path, b"one")
    sinks.write_atomically(path, b"two")
    assert open(path, "rb").read() == b"two" and len(list((tmp_path / "d").iterdir())) == 1
    key = sinks.cache_key({"size": 1}, "stage", {"a": 1})
    assert key == sinks.cache_key({"size": 1}, "stage", {"a": 1}) != sinks.cache_key({"size": 2}, "stage", {"a": 1})
    made = []
    df = spark.range(3)
    for _ in range(2):
        out = sinks.cached(lambda: (made.append(1), df)[1], str(tmp_path / "cache"), key, df.schema)
        assert out.count() == 3
    assert made == [1]
    sinks.export_rows(make(spark, [(1, "a")], "id int, name string"), str(tmp_path / "out"), ["id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "csv")).columns == ["id"]


def test_flattened_maps_and_lines(spark):
    m = make(spark, [(1, {"b": 1.0}, {"a": 2.0}), (2, {}, {"b": 3.0})], "id int, m map<string,double>, n map<string,double>")
    keys = sinks.map_keys_of(m, ["m", "n"])
    assert keys == ["a", "b"] and rows(sinks.flattened(m, ["id"], ["m", "n"], keys), "id", "a", "b") == [(1, 2.0, 1.0), (2, None, 3.0)]
    s = make(spark, [("p", 1, 0.0, 61.25, "build", "v1", None)], "k string, ord int, timeline_in double, timeline_out double, section string, variant_id string, anchor_type string")
    assert sinks.edit_lines(s, ["k"]).first()["line"] == "00:00.000-01:01.250 build      v1 no-payoff"


def test_render_commands(spark):
    s = make(spark, [("p", 1, "/in/a.mp4", 1.25, 4.5, "seg1.mp4"), ("p", 2, "/in/a.mp4", 5.0, 5.0, "seg2.mp4")], "k string, ord int, path string, source_in double, source_out double, file string")
    out = {r["ord"]: r["argv"] for r in render.segment_commands(s, "ffmpeg", "file").collect()}
    assert out[2] is None and out[1][out[1].index("-ss") + 1] == "1.250" and out[1][-1] == "seg1.mp4" and out[1].count("3.250") == 2
    f = s.withColumns({"music_path": F.lit("m.flac"), "music_in": F.lit(19.0), "duration": F.lit(60.0)})
    argv = render.final_commands(f, ["k"], "ffmpeg", F.lit("out.mp4")).first()["argv"]
    assert argv[5:9] == ["-i", "seg1.mp4", "-i", "seg2.mp4"] and "[0:v:0][1:v:0]concat=n=2:v=1:a=0[v]" in argv[argv.index("-filter_complex") + 1]
    ledger = make(spark, [("/in/a.mp4", 4.49)], "path string, duration double")
    assert rows(render.preflight(s, ledger), "rule") == [("range",), ("within",)]
    graphs = make(spark, [(a, m) for a in (True, False) for m in (True, False)], "a boolean, m boolean").withColumn("g", render.audio_graph("a", "m", F.lit(2.0)))
    assert len({r["g"] for r in graphs.collect()}) == 4


# -- reports and pictures ------------------------------------------------------------------------


def test_gold_metrics_per_source_and_pooled(spark):
    d, g = make(spark, [("a", 1.0), ("b", 5.0), ("b", 99.0)], "s string, t double"), make(spark, [("a", 5.1), ("b", 1.1)], "s string, t double")
    windows = make(spark, [("a", 0.0, 10.0), ("b", 0.0, 10.0)], "s string, start double, end double")
    assert rows(reports.gold_metrics(d, g, "s", "t", 0.5, windows), "key", "tp", "fp", "fn") == [("ALL", 0, 2, 2), ("a", 0, 1, 1), ("b", 0, 1, 1)]
    assert ("ALL", 2, 0, 0) in rows(reports.gold_metrics(d, g, "s", "t", 0.5, windows, pooled=True), "key", "tp", "fp", "fn")


def test_boundaries_are_neutral_without_samples(spark):
    seg = make(spark, [(1, "s", 2.0, "ads", "e", "x", 0.9), (2, "s", 50.0, "", "e", "x", 0.9)], "id int, k string, source_in double, view string, environment string, source string, variant_motion double")
    smp = make(spark, [("s", 1.6, 0.2, 0.4, 0.6, 0.1, 0.8), ("s", 2.5, 0.4, 0.4, 0.6, 0.1, 0.6)], "k string, t double, motion double, brightness double, visual double, audio double, activity double")
    got = {r["id"]: r["descriptor"] for r in reports.boundary(seg, smp, "k", ["id"], "source_in").collect()}
    assert got[1]["motion_strength"] == pytest.approx(0.3) and got[1]["impact_strength"] == pytest.approx(0.7) and got[1]["confidence"] == 0.8 and got[1]["motion_direction"] == "forward" and got[1]["ads_state"] == "ads"
    assert (got[2]["motion_strength"], got[2]["impact_strength"], got[2]["confidence"], got[2]["motion_direction"]) == (0.5, 0.0, 0.25, "neutral")


def test_impacts(spark):
    c = make(spark, [(1, "s", 10.0), (2, "s", 20.0)], "id int, k string, t double")
    e = make(spark, [("s", 9.5, 0.9), ("s", 9.9, 0.5), ("s", 10.05, 0.8), ("s", 20.2, 0.9)], "k string, at double, score double")
    assert rows(reports.impact_times(c, e, "k", ["id"]), "id", "impact") == [(1, 10.05), (2, None)]


def test_music_stays_without_a_sure_boundary(spark):
    b = make(spark, [(19.3, 0.9, True), (74.4, 0.8, True), (18.9, 0.95, False), (19.1, 0.6, True)], "t double, confidence double, supported boolean")
    assert tuple(reports.music_interval(b, 19.0, 74.252, 230.0).first()) == (19.3, 74.252, True)
    assert tuple(reports.music_interval(b.filter("not supported"), 19.0, 74.252, 230.0).first()) == (19.0, 74.252, False)


def test_documents(spark):
    r = make(spark, [("p", 1, None)], "k string, shots int, x double")
    assert reports.document(r, ["k"], "v1").first()["report"] == '{"report_version":"v1","shots":1}'
    assert [x["line"] for x in reports.markdown(r, ["k"]).orderBy("ord").collect()] == ["| shots | 1 |", "| x | unavailable |"]
    placed = make(spark, [("p", 1, "v", 10.0, 16.0)], "k string, ord int, variant_id string, timeline_in double, timeline_out double")
    v = make(spark, [("v", 2.0, 8.0, 5.0, "kill", 29.25, 0.8)], "variant_id string, source_in double, source_out double, anchor_t double, anchor_type string, target double, context double")
    shot = reports.shots(placed, v, ["k"], 19.0).first()
    assert (shot["event_timeline"], shot["event_sync"], shot["context"]) == (13.0, 0.25, 1.0)


def test_picture_kernels(spark):
    black, orange = np.zeros((4, 4, 3), np.uint8), np.full((4, 4, 3), (255, 120, 0), np.uint8)
    assert media.orange_ratio(orange) == 1.0 and media.orange_ratio(black) == 0.0 and media.orange_ratio(np.full((2, 2, 3), (0, 0, 255))) == 0.0
    assert media.region_change(None, black) == 0.0 and media.region_change(black, np.full_like(black, 17)) == pytest.approx(0.2) and media.region_change(black, np.full_like(black, 255)) == 1.0
    assert media.border_red_change(black, np.full((4, 4, 3), (51, 0, 0), np.uint8)) == pytest.approx(0.8)
    assert media.region(np.zeros((10, 20)), (0.5, 0.0, 0.5, 0.2)).shape == (2, 1)
    frame = np.random.default_rng(1).random((30, 30))
    assert media.template_hits(frame, frame[5:12, 6:13], 0.99)[0][:2] == (6, 5) and media.best_match(frame, [frame[2:9, 3:9]]) == pytest.approx(1.0)
    f = make(spark, [("s", n, 4, 4, bytearray(x.tobytes())) for n, x in enumerate([black, orange])], "k string, n int, width int, height int, pixels binary")
    out = media.frame_channels(f, ["k"], ["n"], {"whole": (0.0, 0.0, 1.0, 1.0)}).orderBy("n").collect()
    assert (out[0]["whole"], out[0]["orange"]) == (0.0, 0.0) and out[1]["whole"] == 1.0 and out[1]["orange"] == 1.0


def test_rows_and_density(spark):
    d = make(spark, [("f", 0, 10.0, 5.0, 4.0), ("f", 0, 20.0, 5.0, 4.0), ("f", 0, 30.0, 5.0, 4.0), ("f", 1, 10.0, 50.0, 4.0)], "k string, row int, x double, y double, size double")
    assert rows(media.row_geometry(d, ["k"]), "row", "n", "y_score", "size_score", "spacing_score") == [(0, 3, 1.0, 1.0, 1.0), (1, 1, 1.0, 1.0, 1.0)]
    w = make(spark, [("s", float(x)) for x in range(5)], "k string, flux double")
    assert rows(media.waveform_density(w, ["k"]).filter("active"), "flux") == [(3.0,), (4.0,)]


def test_box_and_beam_queries_see_every_row(spark, tmp_path):
    from tidemark.plans import registry

    boxes = [(n, 1, n % 3, float(n * 7 % 50), 0.01 * (n % 11), 100.0 + n * 13 % 997) for n in range(1, 601)]
    make(spark, boxes, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_discount double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    kept = []
    for n, line, supp, q, disc, _ in sorted(boxes, key=lambda b: (-b[5], b[0])):
        x1, y1, x2, y2 = q, disc * 400, q + 6 + line, disc * 400 + 9
        clear = True
        for f, _, a1, b1, a2, b2 in kept:
            common = max(0, min(x2, a2) - max(x1, a1)) * max(0, min(y2, b2) - max(y1, b1))
            apart = (((x1 + x2 - a1 - a2) / 2) ** 2 + ((y1 + y2 - b1 - b2) / 2) ** 2) ** 0.5
            clear &= f != supp or (common / ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - common) < 0.25 and apart > 0.7 * max(x2 - x1, y2 - y1, a2 - a1, b2 - b1))
        if clear:
            kept.append((supp, n * 10 + line, x1, y1, x2, y2))
    assert any(k[1] >= 3000 for k in kept)
    assert rows(registry.queries()["q_box_suppression"](spark, str(tmp_path)), "frame", "id") == sorted((k[:2] for k in kept), key=repr)

    parts = [(n, "b", 1 + n % 7 if n < 400 else 50, 900.0 if n < 400 else 2100.0) for n in range(1, 801)]
    make(spark, parts, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    ids = [int(r["variant_id"]) for r in registry.queries()["q_beam_edit"](spark, str(tmp_path)).collect()]
    assert 3 <= len(ids) <= 8 and min(ids) >= 400
    assert registry.queries()["q_validate_edit"](spark, str(tmp_path)).filter("rule = 'total'").count() == 0


def test_exclusion_queries_see_every_order(spark, tmp_path):
    from datetime import datetime, timedelta

    from tidemark.plans import registry

    at = [(n, 5, datetime(2024, 1, 1) + timedelta(hours=h), "purchase", 50.0, '{"k": 1}') for n, h in ((1, 7.5), (2, 100.0))]
    make(spark, at, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    make(spark, [(7, 155, "1-URGENT"), (10, 6, "5-LOW")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    found = {n: registry.queries()[f"q_{n}"](spark, str(tmp_path)).collect() for n in ("exclusion_anti", "exclusion_reason", "excluded_windows")}
    assert [r["event_id"] for r in found["exclusion_anti"]] == [2]
    assert [(r["source_id"], r["reason"]) for r in found["exclusion_reason"]] == [(5, "1-URGENT")]
    assert [(r["before"], r["kept"]) for r in found["excluded_windows"]] == [(2, 1)]


def test_beam_keeps_a_lane_for_a_comparable_hero(spark):
    v = [("p", f"v{n}", 5.0, 0.9, f"g{n}", f"s{n}", f"e{n}", False) for n in range(4)] + [("p", "h", 5.0, 0.87, "gh", "sh", "eh", True)]
    v = make(spark, v, "project string, variant_id string, duration double, final_score double, duplicate_group string, source string, environment string, is_hero boolean")
    shots = selection.beam_edit(v.withColumn("compatibility", F.when(F.col("is_hero"), 0.0).otherwise(1.0)), ["project"], width=2, shots=(2, 2), seconds=(10.0, 10.0))
    assert [r["variant_id"] for r in shots.orderBy("ord").collect()][-1] == "h"


def test_quality_edit_has_the_budget_of_its_profile(spark, monkeypatch):
    from tidemark.plans import q_projects

    seen = []
    monkeypatch.setattr(q_projects, "_fused", lambda *_: None)
    monkeypatch.setattr(q_projects.P, "variants", lambda _, s: seen.append(s.beam_max_expansions))
    monkeypatch.setattr(q_projects.P, "second_edit", lambda *_: None)
    monkeypatch.setattr(q_projects.P, "summary", lambda *_: None)
    q_projects.q_quality_edit(spark, "")
    assert seen == [65536]


def plain_beam(rows, music, width, shots, seconds, budget, verified=0, margin=0.05, tolerance=0.75):
    """The search written out, one variant at a time over plain tuples."""
    names = ("id", "seconds", "score", "group", "source", "place", "kind", "strong", "kept", "penalty", "kills", "head", "tail")
    rows = sorted((dict(zip(names, r)) for r in rows), key=lambda r: (-r["score"], -r["kills"], r["id"]))
    clip = lambda x: max(0.0, min(1.0, x))
    hero = lambda r: r["kind"] in ("hero", "finale", "hero_play")
    curve = [(0, 0.3), (0.2, 0.5), (0.45, 0.68), (0.6, 0.82), (0.85, 0.9), (1, 1.0)]

    def wanted(x):
        for (a, u), (b, v) in zip(curve, curve[1:]):
            if x <= b:
                return u + (x - a) / (b - a) * (v - u)
        return 1.0

    def energy(t):
        values = [v for _, v in music.energy]
        near = min(music.energy, key=lambda p: abs(p[0] - t))[1]
        return (near - min(values)) / (max(values) - min(values))

    def aim(r, hint):
        if not r["kind"]:
            return hint
        kinds = ("phrase", "downbeat", "strong_beat", "bar") if r["strong"] else ("beat", "onset")
        rank = {"phrase": 5, "downbeat": 4.5, "strong_beat": 4, "bar": 3.5, "beat": 2, "onset": 1}
        best = min((p for p in music.points if p[1] in kinds), key=lambda p: (-rank[p[1]] if r["strong"] else 0, abs(p[0] - hint)))
        return best[0] if abs(best[0] - hint) <= tolerance else hint

    def like(a, b):
        score = 0.28 * (1 if a[0] == b[0] else 0.35) + 0.38 * (1 - abs(a[1] - b[1]) / 5) + 0.12 + 0.12 * (1 if a[2] == b[2] else 0.55) + 0.10
        return round(clip(score * (1 if min(a[3], b[3]) >= 0.5 else 0.65)), 6)

    most = min(seconds[1], music.end - music.start)
    floor = max((r["score"] for r in rows if not hero(r)), default=0.0) - margin
    used, beam, done = 0, [(0.0, 0.0, [])], []
    for _ in range(shots[1]):
        following = []
        for score, at, chosen in beam:
            if len(chosen) >= shots[0] and seconds[0] <= at <= most:
                done.append((score, at, chosen))
            if len(chosen) >= shots[1] or at >= most - 1e-6:
                continue
            own = []
            for r in rows:
                if len(own) >= max(0, budget - used):
                    break
                taken = {c["group"] or c["id"] for c in chosen} | {c["id"] for c in chosen}
                if (r["group"] or r["id"]) in taken or r["id"] in taken or r["kills"] < verified or at + r["seconds"] > seconds[1] + 1e-6:
                    continue
                if len(chosen) > 1 and all(c["seconds"] > 10 for c in [*chosen[-2:], r]):
                    continue
                if r["seconds"] < 2 - 0.001 or r["seconds"] > 12.001 or (r["seconds"] > 10.001 and not hero(r)):
                    continue
                used += 1
                end, hint = at + r["seconds"], music.start + at
                share, target = end / max(seconds[1] if chosen else most, end, 1.0), aim(r, hint)
                fit = clip(1 - abs(energy(target) - wanted(share)))
                variety = 1 - 0.5 * (r["source"] in [c["source"] for c in chosen[-2:]]) - 0.5 * (r["place"] is not None and r["place"] in [c["place"] for c in chosen[-2:]])
                gain = 0.35 * clip(r["score"]) + 0.35 * fit + 0.15 * like((chosen[-1] if chosen else r)["tail"], r["head"]) + 0.15 * clip(variety)
                gain -= 0.1 * (1 - (1.0 if r["kind"] else r["kept"])) + 0.08 * r["penalty"] + 0.04 * min(1, abs(target - hint))
                gain += 0.12 * (share >= 0.85 and hero(r) and r["score"] >= floor)
                own.append((score + gain, end, [*chosen, r]))
            best = sorted(own, key=lambda s: (-s[0], -s[2][-1]["score"], s[2][-1]["id"]))[:width]
            plain = max((s[2][-1]["score"] for s in own if not hero(s[2][-1])), default=0.0)
            heroes = [s for s in own if hero(s[2][-1]) and clip(s[2][-1]["score"]) >= plain - margin]
            if best and heroes and not any(hero(s[2][-1]) for s in best):
                best[-1] = max(heroes, key=lambda s: s[0])
            following += best
            if used >= budget:
                break
        if not following:
            break
        beam = sorted(following, key=lambda s: (-s[0], -s[1], [r["id"] for r in s[2]]))[:width]
    done += [s for s in beam if len(s[2]) >= shots[0] and seconds[0] <= s[1] <= most]
    if not done:
        return []
    best = max(done, key=lambda s: (s[0], sum(1.0 if r["kind"] else r["kept"] for r in s[2]), -abs(s[1] - most)))
    plain = [s for s in done if not hero(s[2][-1])]
    if plain:
        mark = clip(max(plain, key=lambda s: s[0])[2][-1]["score"]) - margin
        best = max((s for s in done if hero(s[2][-1]) and clip(s[2][-1]["score"]) >= mark), key=lambda s: (s[0], clip(s[2][-1]["score"])), default=best)
    return [r["id"] for r in best[2]], round(best[0], 9)


def beam_variants(rng, many):
    side = lambda: (str(rng.choice(list("lrn"))), round(rng.random(), 2), str(rng.choice(list("xyz"))), float(rng.choice([0.3, 0.9])))
    for k in range(many):
        kind = str(rng.choice(["", "kill", "kill", "hero"]))
        yield (f"v{k:02d}", float(rng.integers(1, 14)), round(rng.random(), 3), None if k % 3 == 0 else f"g{k % 7}", f"s{k % 4}", None if k % 5 == 0 else f"e{k % 3}", kind, bool(rng.random() < 0.4), round(rng.random(), 2), round(rng.random() * 0.3, 2), float(rng.integers(0, 3)), side(), side())


@pytest.mark.parametrize("seed,budget", [(0, 100_000), (1, 100_000), (2, 60), (3, 200), (4, 15), (5, 100_000)])
def test_beam_edit_equals_a_plain_search(spark, seed, budget):
    rng = np.random.default_rng(seed)
    music = selection.Music(5.0, 5.0 + [40.0, 34.0][seed % 2], tuple((float(t), float((t * 7) % 11)) for t in range(0, 60, 3)), tuple((float(t) / 2, ["beat", "onset", "bar", "phrase", "strong_beat"][t % 5]) for t in range(120)))
    given = {f"p{k}": list(beam_variants(rng, 24)) for k in range(3)}
    boundary = "struct<motion_direction string, motion_strength double, luminance double, visual_tone double, weapon_motion double, impact_strength double, ads_state string, environment_signature string, source_signature string, confidence double>"
    full = lambda b: (b[0], b[1], 0.5, 0.5, 0.5, 0.5, "n", b[2], "s", b[3])
    rows_ = [(p, *r[:11], bool(r[6]), full(r[11]), full(r[12])) for p, rs in given.items() for r in rs]
    df = make(spark, rows_, f"project string, variant_id string, duration double, final_score double, duplicate_group string, source string, environment string, anchor_type string, anchor_strong boolean, context double, penalty double, verified_kill_count double, has_anchor boolean, head {boundary}, tail {boundary}")
    out = selection.beam_edit(df, ["project"], width=3, shots=(3, 6), seconds=(20.0, 38.0), expansions=budget, music=music, verified=1 if seed == 5 else 0).collect()
    for p, rs in given.items():
        mine = sorted((r for r in out if r["project"] == p), key=lambda r: r["ord"])
        want = plain_beam(rs, music, 3, (3, 6), (20.0, 38.0), budget, 1 if seed == 5 else 0)
        assert ([r["variant_id"] for r in mine], round(mine[0]["score"], 9)) == want if want else not mine


def test_rows_without_a_group_are_groups_of_their_own(spark):
    c = make(spark, [("p", n, n, 10.0, None) for n in range(3)] + [("p", 8, 8, 10.0, "a"), ("p", 9, 9, 10.0, "a")], "k string, id int, o int, d double, g string")
    assert rows(selection.greedy_edit(c, ["k"], ["o"], "d", "g", 60.0), "id") == [(0,), (1,), (2,), (8,)]
    v = make(spark, [("p", f"v{n:02d}", 5.0, 0.9 - n / 100, None, f"s{n}", None) for n in range(30)], "project string, variant_id string, duration double, final_score double, duplicate_group string, source string, environment string")
    assert selection.beam_edit(v, ["project"]).count() >= 9


def test_best_cluster_of_equal_strengths(spark):
    """0.1 + 0.2 + 0.3 is larger than 0.3 + 0.2 + 0.1 by the last bit only: the tighter cluster is the better one."""
    e = spark.createDataFrame([("a", 0.0, 0.1, 1), ("a", 2.0, 0.2, 2), ("a", 4.0, 0.3, 3), ("a", 100.0, 0.3, 4), ("a", 101.0, 0.2, 5), ("a", 102.0, 0.1, 6)], "k string, t double, strength double, event_id int")
    assert [r["first_id"] for r in events.best_cluster(e, ["k"], "t", 4.0, 2).collect()] == [4]


def test_halves_in_the_preview_report(spark):
    shots = spark.range(2000).select(F.lit("v").alias("k"), (F.col("id") + 1).alias("ord"), F.lit("s").alias("source"), F.lit(0.0).alias("source_in"), F.lit(2.0).alias("source_out"), F.when(F.col("id") < 7, 3.0).otherwise(2.0).alias("duration"), F.lit(0.5).alias("score"), F.lit(None).cast("string").alias("duplicate_group"), F.lit(0.001005).alias("sync"), F.lit("cut").alias("transition"))
    lines = [r["line"] for r in reports.preview_report(shots, ["k"]).filter("line like 'Average%'").collect()]
    assert lines == ["Average 2.003 s, shortest 2.000 s, longest 3.000 s."]
