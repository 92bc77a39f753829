"""Queries over events: fusion, merging, clusters, anchors, state machines."""

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import events as O
from ..operators import fsm
from ..sources.tables import EVENTS_SQL, events
from .q_series import r6
from .registry import query

# evidence samples: hours of a source, the strongest event of each type as a channel
_CHANNELS = {"kill": "killfeed_change", "objective": "reward_roi_change", "danger_climax": "damage_border_change", "impact_event": "audio_impact", "visual_transient": "motion_peak"}


def samples(spark, d):
    e = events(spark, d).groupBy("source_id", F.floor(F.col("t") / 12).cast("int").alias("slot"))
    own = [F.coalesce(F.max(F.when(F.col("type") == k, F.col("confidence"))), F.lit(0.0)).alias(c) for k, c in _CHANNELS.items()]
    rest = [F.lit(0.0).alias(c) for c in S.FAMILIES if c not in _CHANNELS.values()]
    return e.agg(*own).select("*", *rest)


_SAMPLES = f"""{EVENTS_SQL}, sm AS (SELECT source_id, CAST(floor(t / 12) AS INTEGER) AS slot, {", ".join(f"coalesce(max(confidence) FILTER (type = '{k}'), 0) AS {c}" for k, c in _CHANNELS.items())} FROM ev GROUP BY ALL),
fu AS (SELECT *, 1 - (1 - killfeed_change) * (1 - reward_roi_change) * (1 - damage_border_change) * (1 - audio_impact) * (1 - motion_peak) AS confidence,
  greatest(killfeed_change, reward_roi_change, damage_border_change, audio_impact, motion_peak) AS top,
  greatest(CASE WHEN reward_roi_change >= 0.35 THEN reward_roi_change ELSE -1 END, CASE WHEN audio_impact >= 0.35 THEN audio_impact ELSE -1 END, CASE WHEN motion_peak >= 0.35 THEN motion_peak ELSE -1 END) AS mate FROM sm),
cl AS (SELECT *, killfeed_change >= 0.35 AND mate >= 0 AND 1 - (1 - killfeed_change) * (1 - mate) >= 0.55 AS is_kill FROM fu WHERE confidence >= 0.35)"""


@query(f"""WITH {_SAMPLES} SELECT source_id, slot, round(confidence, 6) AS confidence, round(0.7 * confidence + 0.3 * top, 6) AS strength,
  array_to_string(list_sort(list_filter([CASE WHEN killfeed_change >= 0.35 THEN 'killfeed_change' END, CASE WHEN reward_roi_change >= 0.35 THEN 'reward_roi_change' END, CASE WHEN damage_border_change >= 0.35 THEN 'damage_border_change' END, CASE WHEN audio_impact >= 0.35 THEN 'audio_impact' END, CASE WHEN motion_peak >= 0.35 THEN 'motion_peak' END], lambda x: x IS NOT NULL)), ',') AS flags FROM cl""")
def q_evidence_fusion(spark, d):
    return O.fuse(samples(spark, d)).select("source_id", "slot", r6("confidence"), r6("strength"), F.array_join("flags", ",").alias("flags"))


@query(f"""WITH {_SAMPLES} SELECT source_id, slot, CASE WHEN is_kill THEN 'kill' WHEN damage_border_change >= 0.5 AND motion_peak >= 0.35 THEN 'danger_climax' WHEN audio_impact >= 0.5 THEN 'impact_event'
  WHEN greatest(reward_roi_change, killfeed_change) >= 0.5 THEN 'visual_transient' ELSE 'combat_climax' END AS type, round(CASE WHEN is_kill THEN 1 - (1 - killfeed_change) * (1 - mate) ELSE 0 END, 6) AS semantic FROM cl""")
def q_classify(spark, d):
    return O.fuse(samples(spark, d)).select("source_id", "slot", "type", r6("semantic"))


_GROUPS = """n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t, event_id) AS i FROM ev),
walk AS (SELECT source_id, i, t, event_id, t AS first, 0 AS grp FROM n WHERE i = 1
  UNION ALL SELECT n.source_id, n.i, n.t, n.event_id, CASE WHEN n.t - w.first > 9 + 1e-9 THEN n.t ELSE w.first END, CASE WHEN n.t - w.first > 9 + 1e-9 THEN w.grp + 1 ELSE w.grp END FROM walk w JOIN n ON n.source_id = w.source_id AND n.i = w.i + 1)"""


@query(f"""WITH RECURSIVE {EVENTS_SQL}, {_GROUPS},
g AS (SELECT ev.*, grp, CASE type WHEN 'visual_transient' THEN 0 WHEN 'impact_event' THEN 1 WHEN 'danger_climax' THEN 2 WHEN 'objective' THEN 4 ELSE 5 END AS r FROM ev JOIN walk USING (event_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY source_id, grp ORDER BY confidence DESC, strength DESC, semantic DESC, t, event_id) AS a, row_number() OVER (PARTITION BY source_id, grp ORDER BY r DESC, t, event_id) AS b FROM g)
SELECT source_id, grp, max(event_id) FILTER (a = 1) AS event_id, round(max(t) FILTER (a = 1), 6) AS t, round(1 - product(1 - confidence), 9) AS confidence, round(max(strength), 6) AS strength, round(max(semantic), 6) AS semantic,
  max(type) FILTER (b = 1) AS type, count(*) AS merged FROM p GROUP BY source_id, grp""")
def q_refractory_merge(spark, d):
    out = O.merge_peaks(events(spark, d), ["source_id"], "t", 9.0)
    return out.select("source_id", F.col("grp").cast("int").alias("grp"), "event_id", r6("t"), F.round("confidence", 9).alias("confidence"), r6("strength"), r6("semantic"), "type", "merged")


@query(f"""WITH RECURSIVE {EVENTS_SQL}, {_GROUPS},
g AS (SELECT ev.source_id, grp, type, confidence, ev.t AS t FROM ev JOIN walk USING (event_id)),
c AS (SELECT source_id, grp, type, max(confidence) AS v, min(t) AS first FROM g GROUP BY ALL)
SELECT source_id, grp, string_agg(type || '=' || CAST(round(v * 10000) AS BIGINT), ',' ORDER BY type) AS evidence, string_agg(type, ',' ORDER BY first) AS flags FROM c GROUP BY ALL""")
def q_map_merge(spark, d):
    g = O.refractory_groups(events(spark, d), ["source_id"], "t", 9.0, ["event_id"]).withColumn("evidence", F.create_map("type", "confidence")).withColumn("flags", F.array("type"))
    out = O.merge_evidence(g, ["source_id", "grp"])
    text = F.array_join(F.transform(F.array_sort(F.map_entries("evidence")), lambda x: F.concat(x["key"], F.lit("="), F.round(x["value"] * 10000).cast("bigint").cast("string"))), ",")
    return out.select("source_id", F.col("grp").cast("int").alias("grp"), text.alias("evidence"), F.array_join("flags", ",").alias("flags"))


@query(f"""WITH {EVENTS_SQL}, k AS (SELECT * FROM ev WHERE type = 'kill' AND semantic >= 0.3 AND confidence >= 0.25 AND strength >= 0.1)
SELECT source_id, k, event_id FROM k QUALIFY row_number() OVER (PARTITION BY source_id, k ORDER BY t DESC) = 1""")
def q_verified(spark, d):
    e = events(spark, d).withColumn("killfeed", F.col("confidence")).withColumn("reward", F.col("strength"))
    return O.verified(e, ["source_id", "k"], "t", semantic=0.3).select("source_id", "k", "event_id")


@query(f"""WITH {EVENTS_SQL}, k AS (SELECT * FROM ev WHERE type = 'kill'), c AS (SELECT source_id, count(*) OVER (PARTITION BY source_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 24.000000001 FOLLOWING) AS n FROM k)
SELECT source_id, max(n) AS best, round(CASE WHEN max(n) >= 3 THEN least(1, max(n) / 3.0) ELSE 0 END, 6)::DOUBLE AS score FROM c GROUP BY source_id""")
def q_rapid_window(spark, d):
    return O.rapid_score(events(spark, d).filter("type = 'kill'"), ["source_id"], "t", 24.0, 3)


_CLUSTERS = f"""{EVENTS_SQL}, k AS (SELECT * FROM ev WHERE type IN ('kill', 'objective')),
c AS (SELECT source_id, event_id AS first_id, t AS first_t, count(*) OVER w AS n, sum(strength) OVER w AS strength, max(t) OVER w AS last_t FROM k WINDOW w AS (PARTITION BY source_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 24.000000001 FOLLOWING)),
q AS (SELECT *, last_t - first_t AS span FROM c WHERE n >= 2)"""


@query(f"""WITH {_CLUSTERS} SELECT source_id, round(first_t, 6) AS first_t, round(last_t, 6) AS last_t, n, round(strength, 6) AS strength, first_id FROM q
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, round(strength, 9) DESC, span, last_t, first_id DESC) = 1""")
def q_best_cluster(spark, d):
    e = events(spark, d).filter("type in ('kill', 'objective')")
    return O.best_cluster(e, ["source_id"], "t", 24.0, 2).select("source_id", r6("first_t"), r6("last_t"), "n", r6("strength"), "first_id")


@query(f"""WITH RECURSIVE {_CLUSTERS}, r AS (SELECT *, round(greatest(0, first_t - 1), 3) AS a, round(last_t + 1, 3) AS b, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, strength DESC, span, first_t, first_id DESC) AS i FROM q),
walk AS (SELECT source_id, i, [{{'a': a, 'b': b}}] AS taken, true AS fits FROM r WHERE i = 1
  UNION ALL SELECT r.source_id, r.i, CASE WHEN f THEN list_append(w.taken, {{'a': r.a, 'b': r.b}}) ELSE w.taken END, f
  FROM walk w JOIN r ON r.source_id = w.source_id AND r.i = w.i + 1, LATERAL (SELECT len(w.taken) < 6 AND len(list_filter(w.taken, lambda x: r.a < x.b AND x.a < r.b)) = 0 AS f))
SELECT r.source_id, r.first_id, r.n, a AS source_in, b AS source_out FROM walk JOIN r USING (source_id, i) WHERE fits""")
def q_nonoverlap_clusters(spark, d):
    e = events(spark, d).filter("type in ('kill', 'objective')")
    return O.apart_clusters(e, ["source_id"], "t", 24.0, 2, 1.0).select("source_id", "first_id", "n", "source_in", "source_out")


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT *, floor(t / 72) * 72 AS a, floor(t / 72) * 72 + 72 AS b FROM ev WHERE confidence >= 0.3 AND strength >= 0.3),
p AS (SELECT *, greatest(0, least(1, (t - a) / 72)) AS place FROM e),
u AS (SELECT *, 0.42::DOUBLE * strength + 0.24::DOUBLE * (CASE type WHEN 'kill' THEN 0.85::DOUBLE WHEN 'objective' THEN 0.8::DOUBLE WHEN 'danger_climax' THEN 0.6::DOUBLE WHEN 'impact_event' THEN 0.5::DOUBLE ELSE 0.32::DOUBLE END) * greatest(semantic, 0.35::DOUBLE)
  + 0.14::DOUBLE * greatest(0, least(1, 1 - abs(place - 0.68::DOUBLE) / 0.68::DOUBLE)) + 0.10::DOUBLE * least(greatest(0, least(1, (t - a) / 2)), greatest(0, least(1, b - t))) AS utility FROM p)
SELECT source_id, CAST(a AS DOUBLE) AS start, event_id, CAST(row_number() OVER w AS INTEGER) AS rank, round(utility, 6) AS utility FROM u WINDOW w AS (PARTITION BY source_id, a ORDER BY utility DESC, t DESC, event_id DESC) QUALIFY row_number() OVER w <= 3""")
def q_anchor_top3(spark, d):
    a = F.floor(F.col("t") / 72) * 72.0
    e = events(spark, d).withColumn("start", a.cast("double")).withColumn("end", (a + 72).cast("double"))
    return O.anchors(e, ["source_id", "start"], "t", "start", "end", weak=0.3).select("source_id", "start", "event_id", "rank", r6("utility"))


@query(f"""WITH {EVENTS_SQL}, k AS (SELECT source_id, t, event_id, CASE WHEN t - lag(t) OVER (PARTITION BY source_id ORDER BY t, event_id) <= 12 THEN 0 ELSE 1 END AS c FROM ev WHERE type IN ('kill', 'objective')),
g AS (SELECT *, sum(c) OVER (PARTITION BY source_id ORDER BY t, event_id) AS seq FROM k)
SELECT source_id, CAST(seq AS BIGINT) AS seq, count(*) AS n, round(min(t), 6) AS first_t, round(max(t), 6) AS last_t, CASE count(*) WHEN 1 THEN 'SINGLE_KILL' WHEN 2 THEN 'DOUBLE_KILL' WHEN 3 THEN 'TRIPLE_KILL' WHEN 4 THEN 'QUAD_KILL' ELSE 'MULTI_5_PLUS' END AS kind FROM g GROUP BY source_id, seq""")
def q_sequences(spark, d):
    return O.sequences(events(spark, d).filter("type in ('kill', 'objective')"), ["source_id"], "t", 12.0).select("source_id", "seq", "n", r6("first_t"), r6("last_t"), "kind")


# states: an event of a source shows a panel unless it is a view; its count is k mod 6
_STATES = f"""{EVENTS_SQL}, st AS (SELECT source_id, t, event_id, type <> 'visual_transient' AS present, k % 6 AS count FROM ev)"""


def states(spark, d):
    return events(spark, d).select("source_id", "t", "event_id", (F.col("type") != "visual_transient").alias("present"), (F.col("k") % 6).alias("count"))


_FSM = f"""{_STATES}, l AS (SELECT *, last_value(CASE WHEN present THEN t END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp FROM st),
i AS (SELECT *, sum(CASE WHEN NOT present AND t - lp >= 12 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY t) AS island FROM l),
m AS (SELECT *, greatest(0, coalesce(max(count) OVER (PARTITION BY source_id, island ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM i WHERE present),
ch AS (SELECT source_id, event_id, t, before, count AS after, count - before AS delta, CASE WHEN count - before = 1 THEN 'event' ELSE 'request' END AS kind FROM m WHERE count - before >= 1)"""


@query(f"WITH {_FSM} SELECT source_id, event_id, before, after, delta, kind FROM ch")
def q_count_fsm(spark, d):
    return fsm.count_changes(states(spark, d), ["source_id"], "t", "present", "count", 12.0).select("source_id", "event_id", "before", "after", "delta", "kind")


@query(f"""WITH {_FSM}, rq AS (SELECT source_id, event_id AS id, before AS f, after AS z, t - 48 AS a, t + 48 AS b FROM ch WHERE kind = 'request'),
sn AS (SELECT rq.*, s.t, s.count, greatest(f, coalesce(max(s.count) OVER (PARTITION BY id ORDER BY s.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f)) AS high FROM rq JOIN st s ON s.source_id = rq.source_id AND s.present AND s.t BETWEEN a AND b),
su AS (SELECT id, f, z, min(t) FILTER (count = z) AS target, max(greatest(high, count)) AS top, max(count - high) FILTER (count > high) AS jump FROM sn GROUP BY ALL)
SELECT id, round(t, 6) AS t, CAST(high AS BIGINT) AS before, CAST(count AS BIGINT) AS after, 'OWN_KILL' AS kind FROM sn JOIN su USING (id) WHERE target IS NOT NULL AND top = su.z AND coalesce(jump, 1) = 1 AND count > high
UNION ALL SELECT id, round(target, 6), CAST(f AS BIGINT), CAST(z AS BIGINT), 'SIMULTANEOUS_MULTI_KILL' FROM su WHERE target IS NOT NULL AND NOT (top = z AND coalesce(jump, 1) = 1)""")
def q_dense_refine(spark, d):
    s = states(spark, d)
    r = fsm.count_changes(s, ["source_id"], "t", "present", "count", 12.0).filter("kind = 'request'")
    r = r.select("source_id", F.col("event_id").alias("id"), "before", "after", (F.col("t") - 48).alias("start"), (F.col("t") + 48).alias("end"))
    return fsm.refine(r, s.select("source_id", "t", "present", "count"), ["source_id"], "id", 96.0).select("id", r6("t"), "before", "after", "kind")


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT source_id, event_id, t, confidence >= 0.3 AS hit, row_number() OVER w AS i, lead(t) OVER w AS nt FROM ev WINDOW w AS (PARTITION BY source_id ORDER BY t, event_id)),
h AS (SELECT *, lag(i) OVER w AS pi, lag(nt) OVER w AS pn FROM n WHERE hit WINDOW w AS (PARTITION BY source_id ORDER BY i))
SELECT source_id, event_id FROM h WHERE pi IS NULL OR (i - pi > 1 AND t - pn + 1e-6 >= 6)""")
def q_debounce(spark, d):
    e = events(spark, d).withColumn("hit", F.col("confidence") >= 0.3)
    return fsm.rising_edges(e, ["source_id"], "t", "hit", 6.0, ["event_id"]).select("source_id", "event_id")


