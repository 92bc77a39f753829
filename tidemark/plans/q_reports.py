"""Queries over reports, boundaries and impacts."""

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import reports as R
from ..operators import series
from ..sources.tables import EVENTS_SQL, events
from .q_series import r6
from .registry import query

_SHOTS = """sh AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY t, event_id) AS ord, 2 + k / 10 AS duration, 's' || k % 4 AS source, 'e' || k % 3 AS environment, type, CASE WHEN type = 'kill' THEN strength END AS anchor, semantic - 0.5::DOUBLE AS es, confidence - 0.5::DOUBLE AS cs, confidence, CASE WHEN type = 'kill' THEN 1 ELSE 0 END AS verified FROM ev)"""


def shots(spark, d):
    from pyspark.sql import Window

    e = events(spark, d).withColumn("ord", F.row_number().over(Window.partitionBy("source_id").orderBy("t", "event_id")))
    kill = F.col("type") == "kill"
    return e.select(
        "source_id", "ord", (2 + F.col("k") / 10).alias("duration"), F.concat(F.lit("s"), F.col("k") % 4).alias("source"), F.concat(F.lit("e"), F.col("k") % 3).alias("environment"),
        F.when(F.col("type") == "objective", "hero").otherwise(F.col("type")).alias("anchor_type"), F.when(kill, F.col("strength")).alias("anchor_strength"),
        (F.col("semantic") - 0.5).alias("event_sync"), (F.col("confidence") - 0.5).alias("cut_sync"), F.col("confidence").alias("compatibility"), F.when(kill, 1).otherwise(0).alias("verified"),
    )


@query(f"""WITH {EVENTS_SQL}, {_SHOTS}, w AS (SELECT *, lag(environment) OVER p AS pe, list(source) OVER (PARTITION BY source_id ORDER BY ord ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS seen FROM sh WINDOW p AS (PARTITION BY source_id ORDER BY ord))
SELECT source_id, count(*) AS shots, round(avg(duration), 9) AS average, round(quantile_cont(duration, 0.5), 6) AS median, count(DISTINCT source) AS sources, count(*) FILTER (type = 'objective') AS heroes, count(anchor) AS anchors, count(*) FILTER (anchor >= 0.75) AS strong,
  round(quantile_disc(abs(es), 0.9), 6) AS event_p90, round(quantile_disc(abs(cs), 0.95), 6) AS cut_p95, count(*) FILTER (environment = pe) AS same_environment, count(*) FILTER (list_contains(seen, source)) AS recent, CAST(sum(verified) AS BIGINT) AS verified, round(sum(verified) / sum(duration) * 10, 6) AS density FROM w GROUP BY source_id""")
def q_edit_metrics(spark, d):
    m = R.edit_metrics(shots(spark, d), ["source_id"])
    return m.select(
        "source_id", F.col("macro_shot_count").alias("shots"), F.round("average_shot_duration", 9).alias("average"), F.round("median_shot_duration", 6).alias("median"), F.col("unique_source_count").alias("sources"), F.col("hero_shot_count").alias("heroes"),
        F.col("payoff_anchor_count").alias("anchors"), F.col("strong_anchor_count").alias("strong"), F.round("event_sync_P90", 6).alias("event_p90"), F.round("cut_sync_P95", 6).alias("cut_p95"), F.col("same_environment_consecutive_count").alias("same_environment"),
        F.col("same_source_recent_penalty_count").alias("recent"), F.col("verified_kill_count").alias("verified"), F.round("verified_kill_density_per_10s", 6).alias("density"),
    )


@query(f"""WITH {EVENTS_SQL}, k AS (SELECT event_id, source_id, t FROM ev WHERE type = 'kill'), x AS (SELECT source_id, t AS tt FROM ev WHERE type <> 'kill' AND confidence >= 0.3),
r AS (SELECT event_id, tt, row_number() OVER (PARTITION BY event_id ORDER BY abs(tt - k.t), tt) AS i FROM k JOIN x ON x.source_id = k.source_id AND tt BETWEEN k.t - 6 AND k.t + 1)
SELECT event_id, round(tt, 6) AS impact FROM k LEFT JOIN r USING (event_id) WHERE i = 1 OR i IS NULL""")
def q_impact_times(spark, d):
    e = events(spark, d)
    ev = e.filter("type <> 'kill'").select("source_id", F.col("t").alias("at"), F.col("confidence").alias("score"))
    return R.impact_times(e.filter("type = 'kill'").select("event_id", "source_id", "t"), ev, "source_id", ["event_id"], "t", 6.0, 1.0, 0.3).select("event_id", r6("impact"))


@query(f"""WITH {EVENTS_SQL}, k AS (SELECT event_id, source_id, t FROM ev WHERE type = 'kill'),
m AS (SELECT k.event_id, avg(x.semantic) AS m, avg(x.confidence) AS b, avg(x.strength) AS v, greatest(avg(x.confidence), avg(x.strength)) AS i FROM k JOIN ev x ON x.source_id = k.source_id AND x.type <> 'kill' AND abs(x.t - k.t) <= 4 GROUP BY k.event_id)
SELECT event_id, round(coalesce(m, 0.5), 9) AS motion, round(coalesce(b, 0.5), 9) AS luminance, round(coalesce(v, 0.5), 9) AS tone, round(coalesce(i, 0), 9) AS impact, CASE WHEN m IS NULL THEN 0.25::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM k LEFT JOIN m USING (event_id)""")
def q_boundary(spark, d):
    e = events(spark, d)
    s = e.filter("type <> 'kill'").select("source_id", "t", F.col("semantic").alias("motion"), F.col("confidence").alias("brightness"), F.col("strength").alias("visual"), F.col("confidence").alias("audio"), F.col("strength").alias("activity"))
    seg = e.filter("type = 'kill'").select("event_id", "source_id", F.col("t").alias("source_in"))
    b = R.boundary(seg, s, "source_id", ["event_id"], "source_in", "t", 4.0)
    nine = lambda c, n: F.round(f"descriptor.{c}", 9).alias(n)
    return b.select("event_id", nine("motion_strength", "motion"), nine("luminance", "luminance"), nine("visual_tone", "tone"), nine("impact_strength", "impact"), F.col("descriptor.confidence").alias("confidence"))


@query(f"""WITH {EVENTS_SQL}, b AS (SELECT source_id, t, confidence, row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, t) AS i FROM ev)
SELECT source_id, round(greatest(0, least(t - 12, 720 - 24)), 6) AS start, round(least(720, greatest(0, least(t - 12, 720 - 24)) + 24), 6) AS "end" FROM b WHERE i = 1""")
def q_fallback_window(spark, d):
    return series.fallback_window(events(spark, d).withColumn("len", F.lit(720.0)), ["source_id"], "t", "confidence", 24.0, "len").select("source_id", r6("start"), r6("end"))


@query(f"""WITH {EVENTS_SQL}, w AS (SELECT source_id, min(t) AS a, max(t) AS b, min(t) FILTER (confidence < 0.6) AS c, max(t) FILTER (confidence < 0.6) AS z FROM ev GROUP BY source_id)
SELECT source_id, round(CASE WHEN coalesce(z - c >= 600, false) THEN c ELSE a END, 6) AS start, round(CASE WHEN coalesce(z - c >= 600, false) THEN z ELSE b END, 6) AS "end", coalesce(z - c >= 600, false) AS trimmed FROM w""")
def q_trimmed_range(spark, d):
    return series.trimmed_range(events(spark, d), ["source_id"], "t", "confidence", 0.6, 600.0).select("source_id", r6("start"), r6("end"), "trimmed")


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT source_id, t, confidence, k % 2 = 0 AS supported FROM ev), m AS (SELECT source_id, t, confidence, side, edge FROM s, (VALUES ('in', 100.0::DOUBLE), ('out', 400.0::DOUBLE)) AS v(side, edge) WHERE supported AND confidence >= 0.3 AND abs(t - edge) <= 40),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, abs(t - edge), side DESC) = 1)
SELECT source_id, round(coalesce(CASE WHEN side = 'in' THEN t END, 100), 3) AS music_in, round(coalesce(CASE WHEN side = 'out' THEN t END, 400), 3) AS music_out, side IS NOT NULL AS changed FROM (SELECT DISTINCT source_id FROM s) LEFT JOIN b USING (source_id)""")
def q_music_interval(spark, d):
    """An interval per source."""
    b = events(spark, d).select("source_id", "t", "confidence", (F.col("k") % 2 == 0).alias("supported"))
    return R.music_interval(b, 100.0, 400.0, 720.0, 40.0, 0.3, ["source_id"])


@query(f"""WITH {EVENTS_SQL} SELECT event_id, round(CASE WHEN t / 720 < 0.2 THEN 0.3 + t / 720 / 0.2 * 0.2 WHEN t / 720 < 0.45 THEN 0.5 + (t / 720 - 0.2) / 0.25 * 0.18 WHEN t / 720 < 0.6 THEN 0.68 + (t / 720 - 0.45) / 0.15 * 0.14 WHEN t / 720 < 0.85 THEN 0.82 + (t / 720 - 0.6) / 0.25 * 0.08 ELSE 0.9 + (t / 720 - 0.85) / 0.15 * 0.1 END, 6)::DOUBLE AS target,
  CASE WHEN t / 720 >= 0.85 THEN 'finale' WHEN t / 720 < 0.2 THEN 'build' WHEN t / 720 < 0.45 THEN 'rise' WHEN t / 720 < 0.6 THEN 'release' ELSE 'escalation' END AS section FROM ev""")
def q_energy_curve(spark, d):
    from ..operators.scoring import energy_target

    return events(spark, d).select("event_id", F.round(energy_target(F.col("t") / 720), 6).alias("target"), S.section("t", F.lit(720.0)).alias("section"))
