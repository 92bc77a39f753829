"""Queries over intervals and time joins."""

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import joins as J
from ..sources.tables import EVENTS_SQL, ORDER_DAYS_SQL, events, order_days, table
from .q_series import r6
from .registry import query

_MERGED = f"""{EVENTS_SQL}, k AS (SELECT event_id, source_id, greatest(0, t - 3) AS a, least(720, t + 4) AS b FROM ev WHERE type = 'kill'),
m AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY source_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2 THEN 0 ELSE 1 END AS c FROM k),
g AS (SELECT *, sum(c) OVER (PARTITION BY source_id ORDER BY a, event_id) AS g FROM m),
w AS (SELECT source_id, g, min(a) AS a, max(b) AS b, count(*) AS n, string_agg(event_id, ',' ORDER BY a, event_id) AS ids FROM g GROUP BY ALL)"""


def merged(spark, d):
    k = events(spark, d).filter("type = 'kill'").select("event_id", "source_id", F.greatest(F.lit(0.0), F.col("t") - 3).alias("a"), F.least(F.lit(720.0), F.col("t") + 4).alias("b"))
    return I.merge_windows(k, ["source_id"], "a", "b", 2.0, ids="event_id", tie=["event_id"])


@query(f"""WITH {_MERGED},
x AS (SELECT source_id, ids, CASE WHEN lag(a) OVER p IS NOT NULL THEN greatest(0, a - 0.75) ELSE a END AS s, least(720, CASE WHEN lead(a) OVER p IS NOT NULL THEN b + 0.75 ELSE b END) AS e FROM w WINDOW p AS (PARTITION BY source_id ORDER BY a)),
t AS (SELECT *, sum(e - s) OVER (PARTITION BY source_id ORDER BY s) AS o, row_number() OVER (PARTITION BY source_id ORDER BY s) AS clip_no FROM x)
SELECT source_id, clip_no, round(s, 6) AS source_in, round(e, 6) AS source_out, round(o - (e - s), 6) AS timeline_in, round(o, 6) AS timeline_out, ids AS event_ids FROM t""")
def q_window_merge_timeline(spark, d):
    """Event windows merged per source, bridged, and laid end to end."""
    clips = I.timeline(I.bridge(merged(spark, d), ["source_id"], 1.5, 0.0, F.lit(720.0)), ["start"], ["source_id"])
    return clips.select("source_id", F.col("clip_no").cast("long").alias("clip_no"), F.round("start", 6).alias("source_in"), F.round("end", 6).alias("source_out"), r6("timeline_in"), r6("timeline_out"), F.array_join(F.transform("event_id", lambda x: x.cast("string")), ",").alias("event_ids"))


_X = """x AS (SELECT o_custkey % 150 AS source_id, o_orderkey AS ord, (o_orderkey % 700)::DOUBLE AS x0, (o_orderkey % 700 + 1 + o_custkey % 5)::DOUBLE AS x1, o_orderpriority AS reason FROM orders)"""


def exclusions(spark, d):
    """All orders as exclusions."""
    o = table(spark, d, "orders")
    x0 = (F.col("o_orderkey") % 700).cast("double")
    return I.valid_exclusions(o.select((F.col("o_custkey") % 150).alias("source_id"), F.col("o_orderkey").alias("ord"), x0.alias("x0"), (x0 + 1 + F.col("o_custkey") % 5).alias("x1"), F.col("o_orderpriority").alias("reason")))


@query(f"""WITH {EVENTS_SQL}, {_X} SELECT event_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.source_id = ev.source_id AND ev.t >= x0 AND ev.t < x1)""")
def q_exclusion_anti(spark, d):
    return I.excluded_points(events(spark, d), exclusions(spark, d), "source_id", "t", 4.0).select("event_id")


@query(f"""WITH {_MERGED}, {_X} SELECT w.source_id, round(a, 6) AS start, round(b, 6) AS "end", arg_min(reason, ord) AS reason FROM w JOIN x ON x.source_id = w.source_id AND b > x0 AND a < x1 GROUP BY ALL""")
def q_exclusion_reason(spark, d):
    w = merged(spark, d)
    return I.exclusion_reasons(w, exclusions(spark, d), "source_id", ["source_id", "start", "end"], 8.0).select("source_id", r6("start"), r6("end"), "reason")


@query(f"""WITH {_MERGED}, {_X} SELECT (SELECT count(*) FROM w) AS before, count(*) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.source_id = w.source_id AND b > x0 AND a < x1)""")
def q_excluded_windows(spark, d):
    w = merged(spark, d)
    kept = I.drop_excluded(w, exclusions(spark, d), "source_id", ["source_id", "start", "end"], 8.0)
    return w.agg(F.count("*").alias("before")).join(kept.agg(F.count("*").alias("kept")))


@query(f"""WITH {_MERGED} SELECT event_id FROM ev WHERE type <> 'kill' AND EXISTS (SELECT 1 FROM w WHERE w.source_id = ev.source_id AND ev.t BETWEEN a AND b)""")
def q_interval_semi(spark, d):
    return I.points_within(events(spark, d).filter("type <> 'kill'"), merged(spark, d), "source_id", "t", 8.0).select("event_id")


@query(f"""WITH {_MERGED} SELECT w.source_id, round(a, 6) AS start, count(*) AS n, round(max(strength), 6) AS payoff FROM ev JOIN w ON w.source_id = ev.source_id AND ev.t BETWEEN a AND b GROUP BY w.source_id, a""")
def q_containment(spark, d):
    inside = I.points_within(events(spark, d), merged(spark, d).select("source_id", "start", "end"), "source_id", "t", 8.0, "inner")
    return inside.groupBy("source_id", "start").agg(F.count("*").alias("n"), F.round(F.max("strength"), 6).alias("payoff")).withColumn("start", F.round("start", 6))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT event_id AS o, source_id, t AS a, t + 2 + k / 50.0 AS b FROM ev)
SELECT DISTINCT x.o AS a, y.o AS b FROM s x JOIN s y ON x.source_id = y.source_id AND x.o < y.o AND x.a < y.b AND y.a < x.b""")
def q_overlap_pairs(spark, d):
    s = events(spark, d).select("event_id", "source_id", F.col("t").alias("start"), (F.col("t") + 2 + F.col("k") / 50).alias("end"))
    return I.overlapping_pairs(s, "source_id", "event_id", 4.0)


@query(f"""WITH {EVENTS_SQL} SELECT x.event_id AS a, y.event_id AS b FROM ev x JOIN ev y ON x.source_id = y.source_id AND x.event_id < y.event_id AND abs(x.t - y.t) <= 4 WHERE x.type IN ('kill', 'objective') AND y.type IN ('kill', 'objective')""")
def q_proximity_pairs(spark, d):
    return I.near_pairs(events(spark, d).filter("type in ('kill', 'objective')"), "source_id", "event_id", "t", 4.0)


@query(f"""WITH {EVENTS_SQL}, k AS (SELECT event_id, source_id, greatest(0, t - 2) AS a, least(720, t + 2) AS b FROM ev WHERE confidence >= 0.5),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY source_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS c FROM k WHERE b > a),
g AS (SELECT *, sum(c) OVER (PARTITION BY source_id ORDER BY a, event_id) AS g FROM m)
SELECT source_id, round(min(a), 6) AS start, round(max(b), 6) AS "end" FROM g GROUP BY source_id, g""")
def q_refinement_windows(spark, d):
    out = I.refinement_windows(events(spark, d).filter("confidence >= 0.5"), ["source_id"], "t", 5.0, 0.0, 720.0, ["event_id"])
    return out.select("source_id", r6("start"), r6("end"))


_REGIONS = f"""{ORDER_DAYS_SQL}, reg AS (SELECT day AS ord, day::DOUBLE AS a, (day + 1 + n % 3)::DOUBLE AS b, CASE WHEN total > 500000 THEN 'high' WHEN total > 250000 THEN 'medium' ELSE 'low' END AS energy FROM od)"""


def regions(spark, d):
    o = order_days(spark, d)
    energy = F.when(F.col("total") > 500000, "high").when(F.col("total") > 250000, "medium").otherwise("low")
    return o.select(F.col("day").alias("ord"), F.col("day").cast("double").alias("start"), (F.col("day") + 1 + F.col("n") % 3).cast("double").alias("end"), energy.alias("energy"))


@query(f"""WITH {EVENTS_SQL}, {_REGIONS} SELECT event_id, (SELECT arg_min(energy, ord) FROM reg WHERE ev.t >= a AND ev.t < b) AS energy FROM ev""")
def q_region_lookup(spark, d):
    return I.region_lookup(events(spark, d).select("event_id", "t"), regions(spark, d).withColumnRenamed("energy", "label"), "t", 4.0, "energy").select("event_id", "energy")


@query(f"""WITH {_REGIONS}, g AS (SELECT (i * 5)::DOUBLE AS s, least(2520::DOUBLE, (i * 5)::DOUBLE + 60) AS e FROM range(0, 496) AS r(i)),
sc AS (SELECT s, e, sum(greatest(0, least(e, b) - greatest(s, a)) * CASE energy WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END) AS score FROM g JOIN reg ON s < b AND a < e WHERE e - s >= 45 GROUP BY s, e)
SELECT s AS start, e AS "end", round(score, 6) AS score FROM sc ORDER BY score DESC, s LIMIT 1""")
def q_music_window(spark, d):
    out = I.best_window(regions(spark, d), 2520.0, (45.0, 60.0), 5.0, {"high": 1.0, "medium": 0.4, "low": 0.1})
    return out.select("start", "end", r6("score"))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT * FROM ev WHERE type = 'visual_transient'),
r AS (SELECT q.event_id, s.t AS nt, s.confidence AS c, row_number() OVER (PARTITION BY q.event_id ORDER BY abs(s.t - q.t), s.t) AS i FROM ev q JOIN s ON s.source_id = q.source_id WHERE q.type = 'kill')
SELECT q.event_id, round(nt, 6) AS nearest_t, round(c, 6) AS confidence FROM ev q LEFT JOIN r ON r.event_id = q.event_id AND i = 1 WHERE q.type = 'kill'""")
def q_nearest_join(spark, d):
    e = events(spark, d)
    q = e.filter("type = 'kill'").select("event_id", "source_id", "t")
    s = e.filter("type = 'visual_transient'").select("source_id", "t", "confidence")
    return J.nearest(q, s, ["source_id"], "t", "t", ["confidence"]).select("event_id", r6("nearest_t"), r6("confidence"))


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT source_id, t, type, CASE type WHEN 'objective' THEN 3 WHEN 'danger_climax' THEN 2 ELSE 1 END AS pr FROM ev WHERE type <> 'kill'),
r AS (SELECT q.event_id, p.t, p.type, row_number() OVER (PARTITION BY q.event_id ORDER BY abs(p.t - q.t), -pr, p.t) AS i FROM ev q JOIN p ON p.source_id = q.source_id AND abs(p.t - q.t) <= 3 WHERE q.type = 'kill')
SELECT q.event_id, round(coalesce(r.t, q.t), 6) AS target, coalesce(r.type, 'none') AS kind, round(coalesce(r.t, q.t) - q.t, 6) AS "offset" FROM ev q LEFT JOIN r ON r.event_id = q.event_id AND i = 1 WHERE q.type = 'kill'""")
def q_tolerance_priority(spark, d):
    e = events(spark, d)
    p = e.filter("type <> 'kill'").select("source_id", "t", "type", F.when(F.col("type") == "objective", 3).when(F.col("type") == "danger_climax", 2).otherwise(1).alias("pr"))
    out = J.nearest_within(e.filter("type = 'kill'").select("event_id", "source_id", "t"), p, ["source_id"], ["event_id"], "t", "t", "pr", 3.0, "type")
    return out.select("event_id", r6("target"), "kind", r6("offset"))


@query(f"""WITH {EVENTS_SQL}, {ORDER_DAYS_SQL}, s AS (SELECT day::DOUBLE * 12 AS t, total AS v FROM od),
j AS (SELECT event_id, ev.t, (SELECT max(t) FROM s WHERE s.t <= ev.t) AS a, (SELECT min(t) FROM s WHERE s.t >= ev.t) AS b FROM ev)
SELECT event_id, round(CASE WHEN a IS NULL THEN y.v WHEN b IS NULL OR a = b THEN x.v ELSE x.v + (j.t - a) / (b - a) * (y.v - x.v) END, 2) AS v FROM j LEFT JOIN s x ON x.t = a LEFT JOIN s y ON y.t = b""")
def q_interp(spark, d):
    q = events(spark, d).select("event_id", "t").withColumn("track", F.lit(1))
    s = order_days(spark, d).select(F.lit(1).alias("track"), (F.col("day").cast("double") * 12).alias("t"), F.col("total").alias("v"))
    return J.interpolate(q, s, ["track"], "t", "t", "v", "v_at", 24.0).select("event_id", F.round("v_at", 2).alias("v"))


_POINTS = "p AS (SELECT DISTINCT floor(t * 2) / 2 + 0.25 AS t, CASE type WHEN 'objective' THEN 'strong_beat' WHEN 'danger_climax' THEN 'bar' WHEN 'impact_event' THEN 'beat' ELSE 'onset' END AS type, CASE type WHEN 'objective' THEN 4.0::DOUBLE WHEN 'danger_climax' THEN 3.5::DOUBLE WHEN 'impact_event' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS rank FROM ev WHERE type <> 'kill')"


@query(f"""WITH {EVENTS_SQL}, {_POINTS}, a AS (SELECT event_id, t, confidence >= 0.5 AND strength >= 0.5 AS strong FROM ev WHERE type = 'kill'),
c AS (SELECT event_id, a.t AS hint, p.t, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN strong THEN -rank ELSE 0 END, abs(p.t - a.t), p.t) AS i FROM a JOIN p ON CASE WHEN strong THEN type IN ('strong_beat', 'bar') ELSE type IN ('beat', 'onset') END)
SELECT event_id, round(CASE WHEN abs(t - hint) <= 0.75 THEN t ELSE hint END, 6) AS target, round(CASE WHEN abs(t - hint) <= 0.75 THEN t - hint ELSE 0 END, 6) AS "offset" FROM c WHERE i = 1""")
def q_anchor_target(spark, d):
    e = events(spark, d)
    kind = F.when(F.col("type") == "objective", "strong_beat").when(F.col("type") == "danger_climax", "bar").when(F.col("type") == "impact_event", "beat").otherwise("onset")
    rank = F.when(F.col("type") == "objective", 4.0).when(F.col("type") == "danger_climax", 3.5).when(F.col("type") == "impact_event", 2.0).otherwise(1.0)
    p = e.filter("type <> 'kill'").select((F.floor(F.col("t") * 2) / 2 + 0.25).alias("t"), kind.alias("type"), rank.alias("rank")).distinct()
    a = e.filter("type = 'kill'").select("event_id", "t", ((F.col("confidence") >= 0.5) & (F.col("strength") >= 0.5)).alias("strong"))
    return J.anchor_targets(a, p, ["event_id"], "t", "strong", 0.75).select("event_id", r6("target"), r6("offset"))
