"""Queries over series."""

from pyspark.sql import functions as F

from ..operators import series as O
from ..sources.tables import DAILY_SQL, EVENTS_SQL, ORDER_DAYS_SQL, daily, events, order_days
from .registry import query


def r6(c):
    return F.round(c, 6).alias(c)


@query(f"""WITH {DAILY_SQL}
SELECT source_id, day, round(coalesce(x - lag(x) OVER (PARTITION BY source_id ORDER BY day), 0), 9) AS diff FROM daily""")
def q_first_diff(spark, d):
    return O.first_difference(daily(spark, d), ["source_id"], ["day"], "x").select("source_id", "day", F.round("diff", 9).alias("diff"))


@query(f"""WITH {DAILY_SQL}
SELECT source_id, day, round(sum(x) OVER (PARTITION BY source_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 9) AS smooth FROM daily""")
def q_box_smooth(spark, d):
    return O.box_smooth(daily(spark, d), ["source_id"], ["day"], "x", 4).select("source_id", "day", F.round("smooth", 9).alias("smooth"))


@query(f"""WITH {DAILY_SQL}, m AS (SELECT source_id, min(x) AS lo, max(x) AS hi FROM daily GROUP BY source_id)
SELECT source_id, day, round(CASE WHEN hi - lo <= 1e-12 THEN 0 ELSE (x - lo) / (hi - lo) END, 6) AS norm FROM daily JOIN m USING (source_id)""")
def q_minmax_norm(spark, d):
    return O.min_max(daily(spark, d), ["source_id"], "x").select("source_id", "day", r6("norm"))


@query(f"""WITH {DAILY_SQL}, m AS (SELECT source_id, quantile_cont(x, 0.05) AS p, quantile_cont(x, 0.95) AS q, min(x) AS lo, max(x) AS hi FROM daily GROUP BY source_id),
b AS (SELECT source_id, CASE WHEN q - p > 1e-12 THEN p ELSE lo END AS a, CASE WHEN q - p > 1e-12 THEN q ELSE hi END AS z FROM m)
SELECT source_id, day, round(CASE WHEN z - a <= 1e-12 THEN 0 ELSE greatest(0, least(1, (x - a) / (z - a))) END, 6) AS norm FROM daily JOIN b USING (source_id)""")
def q_robust_norm(spark, d):
    return O.robust_normalise(daily(spark, d), ["source_id"], "x").select("source_id", "day", r6("norm"))


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT *, lag(confidence) OVER w AS b, lead(confidence) OVER w AS a FROM ev WINDOW w AS (PARTITION BY source_id ORDER BY t, event_id))
SELECT event_id, source_id, round(confidence, 6) AS confidence FROM n WHERE confidence >= coalesce(b, '-inf'::DOUBLE) AND confidence > coalesce(a, '-inf'::DOUBLE)""")
def q_local_peaks(spark, d):
    return O.local_peaks(events(spark, d), ["source_id"], ["t", "event_id"], "confidence").select("event_id", "source_id", r6("confidence"))


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t, event_id) AS i FROM ev),
m AS (SELECT source_id, i, u.name, u.hit FROM n, unnest([{{'name': 'hot', 'hit': confidence >= 0.5}}, {{'name': 'calm', 'hit': confidence <= 0.25 AND semantic <= 0.6}}]) AS x(u)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY source_id, name, hit ORDER BY i) AS run FROM m),
l AS (SELECT source_id, name, hit, run, count(*) AS len FROM g GROUP BY ALL),
c AS (SELECT source_id, count(*) AS n FROM ev GROUP BY ALL)
SELECT c.source_id, round(coalesce(max(len) FILTER (name = 'hot' AND hit), 0) / n, 6) AS hot, round(coalesce(max(len) FILTER (name = 'calm' AND hit), 0) / n, 6) AS calm
FROM c LEFT JOIN l USING (source_id) GROUP BY c.source_id, n""")
def q_longest_runs(spark, d):
    masks = {"hot": F.col("confidence") >= 0.5, "calm": (F.col("confidence") <= 0.25) & (F.col("semantic") <= 0.6)}
    return O.longest_runs(events(spark, d), ["source_id"], ["t", "event_id"], masks)


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT source_id, t - lag(t) OVER (PARTITION BY source_id ORDER BY t, event_id) AS d FROM ev),
st AS (SELECT source_id, coalesce(quantile_cont(d, 0.5) FILTER (d > 0), 1) AS step FROM s GROUP BY source_id),
a AS (SELECT ev.source_id, t, step, event_id, t - lag(t) OVER (PARTITION BY ev.source_id ORDER BY t, event_id) > 6 + step AS far FROM ev JOIN st USING (source_id) WHERE confidence >= 0.25),
g AS (SELECT *, sum(CASE WHEN coalesce(far, true) THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY t, event_id) AS g FROM a),
i AS (SELECT source_id, g, min(t) AS s, max(t) + 2 * any_value(step) AS e FROM g GROUP BY ALL),
p AS (SELECT source_id, s + k * 48 AS start, least(e, s + k * 48 + 48) AS "end" FROM (SELECT *, unnest(range(0, greatest(0, CAST(ceil((e - s) / 48 - 1e-12) AS INTEGER) - 1) + 1)) AS k FROM i))
SELECT source_id, round(start, 6) AS start, round("end", 6) AS "end" FROM p WHERE "end" - start >= 12""")
def q_activity_islands(spark, d):
    out = O.activity_islands(events(spark, d), ["source_id"], "t", "confidence", 0.25, 6.0, 12.0, 48.0, ["event_id"])
    return out.select("source_id", r6("start"), r6("end"))


@query(f"""WITH {EVENTS_SQL}, w AS (SELECT event_id AS id, source_id, t - 6 AS a, t + 6 AS b FROM ev WHERE type = 'kill'),
own AS (SELECT id, avg(x.confidence) AS m, quantile_cont(x.confidence, 0.8) AS h FROM w JOIN ev x ON x.source_id = w.source_id AND x.t BETWEEN a AND b GROUP BY id),
al AS (SELECT source_id, avg(confidence) AS m, quantile_cont(confidence, 0.8) AS h FROM ev GROUP BY source_id)
SELECT w.id AS event_id, round(greatest(0, least(1, coalesce(own.m, al.m))), 6) AS mean, round(greatest(0, least(1, coalesce(own.h, al.h))), 6) AS high FROM w LEFT JOIN own USING (id) JOIN al USING (source_id)""")
def q_window_score(spark, d):
    e = events(spark, d)
    w = e.filter("type = 'kill'").select("event_id", "source_id", (F.col("t") - 6).alias("start"), (F.col("t") + 6).alias("end"))
    mean = O.window_score(e, w, ["source_id"], ["event_id"], "t", "confidence", width=12.0).select("event_id", F.round("score", 6).alias("mean"))
    high = O.window_score(e, w, ["source_id"], ["event_id"], "t", "confidence", True, width=12.0).select("event_id", F.round("score", 6).alias("high"))
    return mean.join(high, "event_id")


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t, event_id) AS i FROM ev),
b AS (SELECT source_id, min(i) AS lo, max(i) AS hi FROM n WHERE confidence < 0.6 GROUP BY source_id)
SELECT event_id, n.source_id FROM n JOIN b ON n.source_id = b.source_id AND i BETWEEN lo AND hi""")
def q_trim_edges(spark, d):
    return O.trim_edges(events(spark, d), ["source_id"], ["t", "event_id"], "confidence", 0.6).select("event_id", "source_id")


@query(f"""WITH {EVENTS_SQL}, b AS (SELECT type, least(4, CAST(floor(confidence * 4) AS INTEGER) + 1) AS bucket FROM ev),
k AS (SELECT DISTINCT type, u.x AS bucket FROM ev, unnest([1, 2, 3, 4]) AS u(x))
SELECT k.type, k.bucket, count(b.bucket) AS n FROM k LEFT JOIN b ON k.type = b.type AND k.bucket = b.bucket GROUP BY ALL""")
def q_histogram(spark, d):
    return O.histogram(events(spark, d), ["type"], "confidence")


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT source_id, t - lag(t) OVER (PARTITION BY source_id ORDER BY t) AS d FROM ev WHERE type = 'impact_event')
SELECT source_id, round(CASE WHEN count(d) >= 2 THEN greatest(0, least(1, 1 - 2 * stddev_pop(d) / avg(d))) ELSE 0 END, 6) AS stability FROM s GROUP BY source_id""")
def q_beat_stability(spark, d):
    return O.beat_stability(events(spark, d).filter("type = 'impact_event'"), ["source_id"], "t").select("source_id", r6("stability"))


@query(f"""WITH {EVENTS_SQL}, b AS (SELECT source_id, t, row_number() OVER (PARTITION BY source_id ORDER BY t) - 1 AS i FROM ev WHERE type = 'impact_event'),
p AS (SELECT source_id, t, CASE WHEN i % 4 = 0 THEN 'bar' WHEN i % 2 = 0 THEN 'strong_beat' ELSE 'beat' END AS type FROM b
  UNION ALL SELECT source_id, t, 'onset' FROM ev o WHERE type = 'visual_transient' AND NOT EXISTS (SELECT 1 FROM b WHERE b.source_id = o.source_id AND abs(b.t - o.t) <= 3))
SELECT DISTINCT source_id, round(t, 3) AS t, type FROM p""")
def q_edit_points(spark, d):
    e = events(spark, d)
    return O.every_nth(e.filter("type = 'impact_event'").select("source_id", "t"), e.filter("type = 'visual_transient'").select("source_id", "t"), ["source_id"], "t", 3.0)


@query(f"""WITH {ORDER_DAYS_SQL}, b AS (SELECT CAST(floor(day / 30.0) AS BIGINT) AS bin, avg(total) AS e FROM od GROUP BY ALL),
s AS (SELECT bin, avg(e) OVER (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS e FROM b),
q AS (SELECT quantile_cont(e, 1.0/3) AS a, quantile_cont(e, 2.0/3) AS z FROM s),
l AS (SELECT bin, e, CASE WHEN e >= z THEN 'high' WHEN e <= a THEN 'low' ELSE 'medium' END AS energy FROM s, q),
r AS (SELECT *, sum(CASE WHEN c THEN 1 ELSE 0 END) OVER (ORDER BY bin) AS r FROM (SELECT *, coalesce(energy <> lag(energy) OVER (ORDER BY bin), true) AS c FROM l)),
g AS (SELECT r, any_value(energy) AS energy, min(bin) * 30 AS start, (max(bin) + 1) * 30 AS "end", avg(e) AS mean FROM r GROUP BY r)
SELECT energy, CAST(start AS DOUBLE) AS start, CAST("end" AS DOUBLE) AS "end", round(mean, 2) AS mean,
  CASE WHEN energy = 'high' THEN 'climax' WHEN energy = 'medium' AND lead(energy) OVER (ORDER BY r) = 'high' THEN 'build_up'
  WHEN energy = 'medium' AND lag(energy) OVER (ORDER BY r) = 'high' THEN 'release' WHEN energy = 'low' THEN 'calm' ELSE 'steady' END AS role FROM g""")
def q_energy_regions(spark, d):
    one = order_days(spark, d).withColumn("track", F.lit(1))
    return O.energy_regions(one, ["track"], "day", "total", 30.0).select("energy", "start", "end", F.round("mean", 2).alias("mean"), "role")
