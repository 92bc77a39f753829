"""Queries over metrics and reports."""

from pyspark.sql import functions as F

from ..operators import metrics as O
from ..sources.tables import EVENTS_SQL, events, table
from .q_series import r6
from .registry import query


@query(f"""WITH RECURSIVE {EVENTS_SQL}, d AS (SELECT source_id, t, row_number() OVER (PARTITION BY source_id ORDER BY t) AS i FROM ev WHERE type = 'kill'),
g AS (SELECT source_id, list(t ORDER BY t) AS ts FROM ev WHERE type = 'objective' GROUP BY source_id),
s AS (SELECT DISTINCT source_id FROM ev WHERE type IN ('kill', 'objective')),
walk AS (SELECT s.source_id, 0::BIGINT AS i, coalesce(ts, []) AS free, 0::BIGINT AS tp FROM s LEFT JOIN g USING (source_id)
  UNION ALL SELECT w.source_id, d.i, CASE WHEN b IS NULL THEN w.free ELSE list_filter(w.free, lambda x: x <> b) END, w.tp + CASE WHEN b IS NULL THEN 0 ELSE 1 END
  FROM walk w JOIN d ON d.source_id = w.source_id AND d.i = w.i + 1, LATERAL (SELECT (list_sort(list_transform(list_filter(w.free, lambda x: abs(x - d.t) <= 8), lambda x: {{'a': abs(x - d.t), 'x': x}})))[1].x AS b)),
l AS (SELECT source_id, max(tp) AS tp FROM walk GROUP BY source_id)
SELECT source_id, tp, (SELECT count(*) FROM d WHERE d.source_id = l.source_id) - tp AS fp, (SELECT count(*) FROM ev WHERE ev.source_id = l.source_id AND type = 'objective') - tp AS fn FROM l""")
def q_greedy_match(spark, d):
    e = events(spark, d)
    return O.greedy_match(e.filter("type = 'kill'"), e.filter("type = 'objective'"), ["source_id"], "t", 8.0)


@query("""WITH j AS (SELECT l.quality, l.toxic, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT count(*) AS samples, count(*) FILTER (quality = 1 AND n_chars > 500) AS hits, count(*) FILTER (quality = 1 AND n_chars > 500 AND toxic = n_chars % 2) AS "full", count(*) FILTER (quality <> 1 AND n_chars > 500) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 500) AS fn FROM j)
SELECT *, round(hits / (hits + fp), 6) AS precision, round(hits / (hits + fn), 6) AS recall FROM c""")
def q_calibration(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    out = O.calibration(j, F.col("quality") == 1, F.col("n_chars") > 500, F.col("toxic"), F.col("n_chars") % 2)
    return out.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query("""WITH x AS (SELECT l_returnflag, abs(l_extendedprice / 1000 - l_quantity) AS o FROM lineitem)
SELECT l_returnflag, round(avg(o), 5) AS mean, round(quantile_cont(o, 0.5), 5) AS median, round(quantile_disc(o, 0.9), 6) AS p90, round(quantile_disc(o, 0.95), 6) AS p95, count(*) AS n FROM x GROUP BY ALL""")
def q_sync_stats(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000 - F.col("l_quantity")).alias("o"))
    return O.offset_stats(x, ["l_returnflag"], "o").select("l_returnflag", F.round("mean", 5).alias("mean"), F.round("median", 5).alias("median"), r6("p90"), r6("p95"), "n")


@query("""WITH a AS (SELECT count(*)::DOUBLE AS shots, sum(l_quantity) AS seconds, max(l_discount) AS worst FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT count(*)::DOUBLE AS shots, sum(l_quantity) AS seconds, avg(l_tax) AS tax FROM lineitem WHERE l_returnflag = 'R')
SELECT metric, round(v1, 6) AS v1, round(v2, 6) AS v2, round(v2 - v1, 6) AS delta, v1 IS NOT NULL AND v2 IS NOT NULL AS available FROM (
  SELECT 'shots' AS metric, a.shots AS v1, b.shots AS v2 FROM a, b UNION ALL SELECT 'seconds', a.seconds, b.seconds FROM a, b UNION ALL SELECT 'worst', worst, NULL FROM a UNION ALL SELECT 'tax', NULL, tax FROM b)""")
def q_metric_compare(spark, d):
    li = table(spark, d, "lineitem")
    a = li.filter("l_returnflag = 'A'").agg(F.count("*").alias("shots"), F.sum("l_quantity").alias("seconds"), F.max("l_discount").alias("worst"))
    b = li.filter("l_returnflag = 'R'").agg(F.count("*").alias("shots"), F.sum("l_quantity").alias("seconds"), F.avg("l_tax").alias("tax"))
    return O.compare(a, b, ["shots", "seconds", "worst", "tax"]).select("metric", r6("v1"), r6("v2"), r6("delta"), "available")


_KINDS = ("kill", "objective", "danger_climax", "impact_event", "visual_transient")


@query(f"""WITH {EVENTS_SQL} SELECT source_id, {", ".join(f"count(*) FILTER (type = '{k}') AS {k}" for k in _KINDS)}, count(*) AS total FROM ev GROUP BY source_id""")
def q_type_rollup(spark, d):
    return O.rollup(events(spark, d), ["source_id"], "type", _KINDS)


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT source_id, t - lag(t) OVER (PARTITION BY source_id ORDER BY t) AS d FROM ev)
SELECT source_id, count(*) FILTER (d < 1) AS under_1, count(*) FILTER (d < 0.5) AS under_half, round(min(d), 6) AS least FROM g GROUP BY source_id""")
def q_short_intervals(spark, d):
    return O.short_intervals(events(spark, d), ["source_id"], "t", {"under_1": 1.0, "under_half": 0.5}).withColumn("least", F.round("least", 6))


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT source_id, type, row_number() OVER (PARTITION BY source_id ORDER BY t, event_id) AS i FROM ev) SELECT source_id, type, count(*) AS n FROM n WHERE i > 1 GROUP BY ALL""")
def q_transition_counts(spark, d):
    return O.transition_counts(events(spark, d), ["source_id"], ["t", "event_id"], "type")


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT type, source_id, k % 3 AS env, lag(k % 3) OVER w AS pe, list(source_id) OVER (PARTITION BY type ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS seen FROM ev WINDOW w AS (PARTITION BY type ORDER BY t, event_id))
SELECT type, count(*) FILTER (list_contains(seen, source_id)) AS reused, count(*) FILTER (env = pe) AS consecutive FROM n GROUP BY type""")
def q_recent_reuse(spark, d):
    e = events(spark, d).withColumn("env", F.col("k") % 3)
    return O.recent_reuse(e, ["type"], ["t", "event_id"], "source_id", "env", 3)
