"""Queries over whole projects."""

from pyspark.sql import functions as F

from ..sources.config import Settings, quality_profile, settings
from ..sources.tables import EVENTS_SQL, events
from . import projects as P
from .q_events import _FSM, samples, states
from .q_series import r6
from .registry import query

# an hour of the tables stands for a second of a recording
HOURS = settings({"activity_merge_gap": 6.0, "highlight_min_duration": 12.0, "highlight_max_duration": 48.0, "preview_min_duration": 60.0, "preview_max_duration": 240.0, "rapid_multikill_window_s": 24.0, "v2_min_shots": 3, "v2_max_shots": 8, "beam_max_expansions": 32768, "preferred_macro_duration": [2.0, 40.0], "v6_panel_disappear_s": 5.0, "v6_refinement_radius_s": 5.0})


@query(f"""WITH {EVENTS_SQL}, k AS (SELECT event_id, source_id, greatest(0, t - 3) AS a, least(720, t + 4) AS b FROM ev WHERE type = 'kill'),
m AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY source_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2 THEN 0 ELSE 1 END AS c FROM k),
g AS (SELECT *, sum(c) OVER (PARTITION BY source_id ORDER BY a, event_id) AS g FROM m),
w AS (SELECT source_id, g, min(a) AS a, max(b) AS b, string_agg(event_id, ',' ORDER BY a, event_id) AS ids FROM g GROUP BY ALL),
x AS (SELECT source_id, ids, CASE WHEN lag(a) OVER p IS NOT NULL THEN greatest(0, a - 0.75) ELSE a END AS s, least(720, CASE WHEN lead(a) OVER p IS NOT NULL THEN b + 0.75 ELSE b END) AS e FROM w WINDOW p AS (PARTITION BY source_id ORDER BY a)),
t AS (SELECT *, sum(e - s) OVER (ORDER BY source_id DESC, s) AS o, row_number() OVER (ORDER BY source_id DESC, s) AS i FROM x)
SELECT 'clip-' || lpad(CAST(i AS VARCHAR), 4, '0') AS clip_id, source_id, round(s, 6) AS source_in, round(e, 6) AS source_out, round(o - (e - s), 5) AS timeline_in, round(o, 5) AS timeline_out, ids AS event_ids FROM t""")
def q_project(spark, d):
    e = events(spark, d).filter("type = 'kill'")
    ledger = e.select("source_id").distinct().select("source_id", (-F.col("source_id")).alias("ord"), F.lit(720.0).alias("duration"))
    c = P.generate(e.select("event_id", "source_id", "t"), ledger, 3.0, 4.0, 2.0, 1.5)
    return c.select("clip_id", "source_id", r6("source_in"), r6("source_out"), F.round("timeline_in", 5).alias("timeline_in"), F.round("timeline_out", 5).alias("timeline_out"), F.array_join(F.transform("event_ids", lambda x: x.cast("string")), ",").alias("event_ids"))


@query()
def q_first_edit(spark, d):
    e = events(spark, d)
    s = e.select("source_id", "t", F.col("semantic").alias("motion"), F.col("strength").alias("visual"), F.col("confidence").alias("audio"), F.lit(0.5).alias("continuity"), F.col("confidence").alias("activity"))
    c = P.candidates(s, HOURS)
    ids = c.select("candidate_id", "source_id", F.round("duration").alias("r"))
    a, b = ids.alias("a"), ids.alias("b")  # stands in for pictures: equal rounded lengths within a source
    alike = a.join(b, (F.col("a.source_id") == F.col("b.source_id")) & (F.col("a.r") == F.col("b.r")) & (F.col("a.candidate_id") < F.col("b.candidate_id"))).select(F.col("a.candidate_id").alias("a"), F.col("b.candidate_id").alias("b"))
    out = P.first_edit(c, alike, HOURS, F.col("source_id") % 10)
    return out.select("project", "candidate_id", r6("timeline_in"), r6("used"), "final_score")


def _fused(spark, d):
    from ..operators.events import fuse

    return fuse(samples(spark, d)).withColumn("t", F.col("slot") * 12.0).withColumn("event_id", F.col("source_id") * 1000 + F.col("slot"))


@query()
def q_second_edit(spark, d):
    v = P.variants(_fused(spark, d), HOURS)
    return P.second_edit(v, HOURS, F.col("source_id") % 10).withColumn("score", F.round("score", 6))


@query()
def q_quality_edit(spark, d):
    from dataclasses import replace

    s: Settings = replace(quality_profile(HOURS), preview_min_duration=60.0, preview_max_duration=240.0, v2_min_shots=3, v2_max_shots=8, v5_min_kill_semantic_confidence=0.6)
    v = P.variants(_fused(spark, d), s)
    return P.summary(P.second_edit(v, s, F.col("source_id") % 10), ["project"])


@query(f"""WITH {_FSM.replace(">= 12", ">= 5")}, rq AS (SELECT source_id, source_id || ':' || event_id AS id, before AS f, after AS z, t - 5 AS a, t + 5 AS b FROM ch WHERE kind = 'request'),
sn AS (SELECT rq.*, s.t, s.count, greatest(f, coalesce(max(s.count) OVER (PARTITION BY id ORDER BY s.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f)) AS high FROM rq JOIN st s ON s.source_id = rq.source_id AND s.present AND s.t BETWEEN a AND b),
su AS (SELECT source_id, id, f, z, min(t) FILTER (count = z) AS target, max(greatest(high, count)) AS top, max(count - high) FILTER (count > high) AS jump FROM sn GROUP BY ALL),
al AS (SELECT source_id, t, after, before, 'OWN_KILL' AS kind, 0 AS o FROM ch WHERE kind = 'event'
  UNION ALL SELECT sn.source_id, t, count, high, 'OWN_KILL', 1 FROM sn JOIN su USING (id) WHERE target IS NOT NULL AND top = su.z AND coalesce(jump, 1) = 1 AND count > high
  UNION ALL SELECT source_id, target, z, f, 'SIMULTANEOUS_MULTI_KILL', 1 FROM su WHERE target IS NOT NULL AND NOT (top = z AND coalesce(jump, 1) = 1)),
fo AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY source_id, t, after ORDER BY o, before, kind) = 1),
n AS (SELECT source_id, count(*) FILTER (kind = 'OWN_KILL') AS own, count(*) FILTER (kind <> 'OWN_KILL') AS sim, count(*) AS total FROM fo GROUP BY source_id)
SELECT s.source_id, coalesce(own, 0) AS "OWN_KILL", coalesce(sim, 0) AS "SIMULTANEOUS_MULTI_KILL", coalesce(total, 0) AS total, CASE WHEN total > 0 THEN 'EVENTS' ELSE 'EMPTY' END AS status FROM (SELECT DISTINCT source_id FROM ev) s LEFT JOIN n USING (source_id)""")
def q_count_truth(spark, d):
    found, _ = P.count_truth(states(spark, d), HOURS)
    return P.truth_summary(found, events(spark, d))
