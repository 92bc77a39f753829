"""Queries over sources, ids and byte statistics."""

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import media
from ..sources import media_index as M
from ..sources.tables import table
from .q_series import r6
from .registry import query


@query("""WITH p AS (SELECT page_id, page_id * 7 % 500 AS duration, CASE page_id % 4 WHEN 0 THEN '60000/1001' WHEN 1 THEN '30/0' WHEN 2 THEN '25' ELSE 'x' END AS fps, CASE page_id % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN '' ELSE CAST(page_id * 1000 AS VARCHAR) END AS br FROM pages)
SELECT page_id, duration::DOUBLE AS duration, CASE WHEN duration <= 90 THEN 'short_clip' WHEN duration <= 300 THEN 'medium_clip' ELSE 'long_recording' END AS category,
  CASE page_id % 4 WHEN 0 THEN 59.94::DOUBLE WHEN 2 THEN 25::DOUBLE ELSE 0::DOUBLE END AS fps, TRY_CAST(nullif(nullif(br, ''), 'N/A') AS BIGINT) AS bitrate, 'h264' AS codec, 2::BIGINT AS audio_channels FROM p""")
def q_media_index(spark, d):
    p = table(spark, d, "pages")
    fps = F.expr("CASE page_id % 4 WHEN 0 THEN '60000/1001' WHEN 1 THEN '30/0' WHEN 2 THEN '25' ELSE 'x' END")
    rate = F.expr("CASE page_id % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN '' ELSE cast(page_id * 1000 AS string) END")
    video = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.lit(1920).alias("width"), F.lit(1200).alias("height"), fps.alias("avg_frame_rate"), F.lit(None).cast("string").alias("channels"))
    audio = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit("0/0").alias("avg_frame_rate"), F.lit("2").alias("channels"))
    probe = F.to_json(F.struct(F.struct((F.col("page_id") * 7 % 500).cast("string").alias("duration"), rate.alias("bit_rate")).alias("format"), F.array(audio, video).alias("streams")))
    return M.probed(p.select("page_id", probe.alias("probe"))).select("page_id", "duration", "category", "fps", "bitrate", "codec", "audio_channels")


@query("""WITH b AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\x00-\\x7F]')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS s FROM n GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(-sum(n / s * log2(n / s)) / 8, 0), 6) AS entropy FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) GROUP BY d.doc_id""")
def q_entropy(spark, d):
    ascii_only = F.encode(F.regexp_replace("text", r"[^\x00-\x7F]", ""), "utf-8")
    return media.byte_entropy(table(spark, d, "documents").select("doc_id", ascii_only.alias("b")), ["doc_id"], "b").select("doc_id", r6("entropy"))


@query("""SELECT o_orderkey, 'cand-' || substr(sha1(CAST(o_custkey AS VARCHAR) || '|' || CAST(o_orderkey * 250 AS VARCHAR) || '|' || CAST(o_orderkey * 250 + 6000 AS VARCHAR)), 1, 12) AS candidate_id,
  lpad(CAST(o_orderkey * 250 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey * 250 // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(o_orderkey * 250 % 1000 AS VARCHAR), 3, '0') AS at FROM orders""".replace(" AS at ", " AS start_at "))
def q_content_ids(spark, d):
    o = table(spark, d, "orders")
    ms = F.col("o_orderkey") * 250
    return o.select("o_orderkey", S.content_id("cand", "o_custkey", ms, ms + 6000).alias("candidate_id"), S.clock(ms / 1000).alias("start_at"))


@query("""WITH l AS (SELECT DISTINCT source AS source_id, CASE WHEN source < 'src15' THEN 'DONE' ELSE 'PENDING' END AS status FROM documents WHERE source < 'src2'),
a AS (SELECT DISTINCT source AS source_id FROM documents)
SELECT source_id, CASE WHEN source_id IN ('src1', 'src3') THEN 'EXCLUDED' ELSE coalesce(status, 'PENDING') END AS status, source_id IN ('src1', 'src3') AS editorial_excluded FROM a LEFT JOIN l USING (source_id)""")
def q_ledger(spark, d):
    sources = table(spark, d, "documents").select(F.col("source").alias("source_id")).distinct()
    ledger = sources.filter("source_id < 'src2'").select("source_id", F.when(F.col("source_id") < "src15", "DONE").otherwise("PENDING").alias("status"), F.lit(False).alias("editorial_excluded"))
    updates = sources.filter("source_id in ('src1', 'src3')").withColumn("status", F.lit("EXCLUDED"))
    return M.set_status(M.merge_ledger(ledger, sources), updates).select("source_id", "status", "editorial_excluded")


@query("""SELECT page_id, side FROM (SELECT page_id, 'removed' AS side FROM pages WHERE page_id % 10 = 3 UNION ALL SELECT page_id, 'added' FROM pages WHERE page_id % 10 = 4)""")
def q_manifest_changes(spark, d):
    p = table(spark, d, "pages").select("page_id", F.length("html").alias("size"))
    return M.manifest_changes(p.filter("page_id % 10 <> 4"), p.filter("page_id % 10 <> 3")).select("page_id", "side")


@query("""WITH r AS (SELECT o_orderkey AS id, 1280 + 640 * (o_custkey % 3) AS width, 720 + 480 * (o_custkey % 2) AS height FROM orders)
SELECT id, CASE WHEN width = 1920 AND height = 1200 THEN 'a' WHEN width = 1280 AND height = 720 THEN 'b' END AS profile_id, CASE WHEN (width = 1920 AND height = 1200) OR (width = 1280 AND height = 720) THEN 'OK' ELSE 'UNPROFILED' END AS status FROM r""")
def q_profiles(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (1280 + 640 * (F.col("o_custkey") % 3)).cast("int").alias("width"), (720 + 480 * (F.col("o_custkey") % 2)).cast("int").alias("height"))
    profiles = spark.createDataFrame([("a", 1, 1920, 1200), ("c", 2, 1920, 1200), ("b", 3, 1280, 720)], "profile_id string, ord int, width int, height int")
    return M.profile_lookup(r, profiles).select("id", "profile_id", "status")
