"""Queries over streams: the same rows as their batch forms."""

from pyspark.sql import functions as F

from ..sources.tables import EVENTS_SQL, LABELS, hours
from ..streaming import machines as M
from .q_events import _FSM
from .registry import query


def _events(spark, d):
    e = M.file_stream(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("event_type"))
    return e.select("event_id", F.col("user_id").alias("source_id"), hours("ts").alias("t"), kind.alias("type"), k.alias("k"), (F.col("value") >= 30).alias("hit"), F.col("ts").cast("timestamp_ltz").alias("ts"), "value")


@query(f"WITH {_FSM} SELECT source_id, event_id, CAST(before AS INTEGER) AS before, after, CAST(delta AS INTEGER) AS delta, kind FROM ch")
def q_stream_count_fsm(spark, d):
    s = _events(spark, d).select("source_id", "event_id", "t", (F.col("type") != "visual_transient").alias("present"), (F.col("k") % 6).alias("count"))
    return M.drain(spark, M.count_machine(s, 12.0)).drop("t")


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT source_id, event_id, t, confidence >= 0.3 AS hit, row_number() OVER w AS i, lead(t) OVER w AS nt FROM ev WINDOW w AS (PARTITION BY source_id ORDER BY t, event_id)),
h AS (SELECT *, lag(i) OVER w AS pi, lag(nt) OVER w AS pn FROM n WHERE hit WINDOW w AS (PARTITION BY source_id ORDER BY i))
SELECT source_id, event_id FROM h WHERE pi IS NULL OR (i - pi > 1 AND t - pn + 1e-6 >= 6)""")
def q_stream_debounce(spark, d):
    return M.drain(spark, M.edges(_events(spark, d).select("source_id", "event_id", "t", "hit"), 6.0)).drop("t")


@query("""SELECT event_type AS type, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') AS slot, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def q_stream_tumbling(spark, d):
    e = M.file_stream(spark, d, "events").select(F.col("event_type").alias("type"), F.col("ts").cast("timestamp_ltz").alias("ts"), "value")
    out = M.drain(spark, M.tumbling(e, "ts", "6 hours", ["type"]), "complete")
    return out.select("type", F.col("start").cast("timestamp_ntz").alias("slot"), "n", F.round("total", 4).alias("total"))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM l) SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) + INTERVAL '6 hours' AS last_ts FROM g GROUP BY user_id, g""")
def q_sessions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ltz"))
    out = M.sessions(e, "ts", "6 hours", ["user_id"])
    return out.select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("first_ts"), F.col("end").cast("timestamp_ntz").alias("last_ts"))
