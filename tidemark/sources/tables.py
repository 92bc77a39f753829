"""The supplied tables as signals: the bindings that the registered queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Microseconds of 2024-01-01; times are hours since then.
EPOCH_US = 1704067200000000
#: Event types as labels.
LABELS = {"purchase": "kill", "signup": "objective", "error": "danger_climax", "click": "impact_event", "view": "visual_transient"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours(ts: str):
    """Hours since the epoch of a timestamp without zone."""
    return (F.unix_micros(F.col(ts).cast("timestamp_ltz")) - F.lit(EPOCH_US)) / F.lit(3.6e9)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, source_id, t, type, confidence, semantic, strength, k."""
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    k = F.get_json_object("props", "$.k").cast("double")
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("user_id").alias("source_id"),
        hours("ts").alias("t"),
        F.element_at(label, F.col("event_type")).alias("type"),
        S.clamp(F.col("value") / 100).alias("confidence"),
        S.clamp(k / 100).alias("semantic"),
        S.clamp((F.col("value") + k) / 200).alias("strength"),
        F.coalesce(k, F.lit(0.0)).cast("int").alias("k"),
    )


EVENTS_SQL = f"""ev AS (
  SELECT event_id, user_id AS source_id, CAST(epoch_us(ts) - {EPOCH_US} AS DOUBLE) / 3600000000::DOUBLE AS t,
    CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LABELS.items())} END AS type,
    greatest(0::DOUBLE, least(1::DOUBLE, value / 100)) AS confidence,
    greatest(0::DOUBLE, least(1::DOUBLE, CAST(props->>'$.k' AS DOUBLE) / 100)) AS semantic,
    greatest(0::DOUBLE, least(1::DOUBLE, (value + CAST(props->>'$.k' AS DOUBLE)) / 200)) AS strength,
    CAST(props->>'$.k' AS INTEGER) AS k
  FROM events)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, day, x, n: each user's mean value a day."""
    return events(spark, sf_dir).groupBy("source_id", F.floor(F.col("t") / 24).cast("int").alias("day")).agg(F.avg(F.col("strength")).alias("x"), F.count("*").alias("n"))


DAILY_SQL = EVENTS_SQL + """,
daily AS (SELECT source_id, CAST(floor(t / 24) AS INTEGER) AS day, avg(strength) AS x, count(*) AS n FROM ev GROUP BY ALL)"""


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, total, n: the orders' daily sums, days since 1992-01-01."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("n"))


ORDER_DAYS_SQL = """od AS (
  SELECT CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM orders GROUP BY ALL)"""
