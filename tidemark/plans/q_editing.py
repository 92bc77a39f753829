"""Queries over the rules of editing, exports and render commands."""

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import media, render, reports, selection, sinks
from ..sources import media_index, workflow
from ..sources.tables import EVENTS_SQL, events, table
from .q_series import r6
from .registry import query


@query("""WITH r AS (SELECT o_orderkey AS id, (o_orderkey % 100) / 200.0::DOUBLE AS a, (o_custkey % 100) / 200.0::DOUBLE AS b FROM orders),
s AS (SELECT *, a + (id % 7 + 1) / 20.0::DOUBLE AS c, b + (id % 9 + 1) / 20.0::DOUBLE AS d FROM r)
SELECT id, CAST(round_even(a * 1900, 0) AS INTEGER) AS x1, CAST(round_even(b * 1000, 0) AS INTEGER) AS y1, CAST(round_even(c * 1900, 0) AS INTEGER) AS x2, CAST(round_even(d * 1000, 0) AS INTEGER) AS y2,
  CAST(floor(a * 1900) AS INTEGER) AS left_edge, CAST(floor(d * 1000) AS INTEGER) AS bottom_edge FROM s""")
def q_pixel_rect(spark, d):
    id_, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = (id_ % 100) / 200, (c % 100) / 200
    o = table(spark, d, "orders").select(id_.alias("id"), F.struct(x.alias("x1"), y.alias("y1"), (x + (id_ % 7 + 1) / 20).alias("x2"), (y + (id_ % 9 + 1) / 20).alias("y2")).alias("r"), F.lit(1900).alias("w"), F.lit(1000).alias("h"))
    whole = o.select("id", S.pixel_rect("r", "w", "h").alias("p"), S.pixel_rect("r", "w", "h", truncate=True).alias("t"))
    return whole.select("id", "p.*", F.col("t.x1").alias("left_edge"), F.col("t.y2").alias("bottom_edge"))


@query("""WITH v AS (SELECT o_orderkey AS id, (o_orderkey % 400) / 10.0::DOUBLE AS d, CASE o_custkey % 4 WHEN 0 THEN 'hero' WHEN 1 THEN 'kill' WHEN 2 THEN NULL ELSE 'finale' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'bar_boundary' ELSE ' ' END AS reason, (o_orderkey % 11) / 10.0::DOUBLE AS kept, o_orderkey % 5 = 0 AS saved FROM orders)
SELECT id, d >= 1.999::DOUBLE AND CASE WHEN saved THEN d <= 30.001::DOUBLE ELSE d <= 12.001::DOUBLE AND (d <= 10.001::DOUBLE OR coalesce(kind IN ('hero', 'finale'), false) OR (trim(reason) <> '' AND kept >= 0.7::DOUBLE)) END AS allowed FROM v""")
def q_duration_policy(spark, d):
    id_ = F.col("o_orderkey")
    kind = F.element_at(F.array(F.lit("hero"), F.lit("kill"), F.lit(None), F.lit("finale")), (F.col("o_custkey") % 4 + 1).cast("int"))
    reason = F.when(id_ % 3 == 0, "bar_boundary").otherwise(" ")
    return table(spark, d, "orders").select(id_.alias("id"), S.duration_allowed((id_ % 400) / 10, kind, reason, (id_ % 11) / 10, preserved=id_ % 5 == 0).alias("allowed"))


@query("""WITH v AS (SELECT o_orderkey AS id, 4 + o_orderkey % 31 AS e, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE (o_custkey % 30) / 2.0::DOUBLE END AS t, (o_orderkey % 5) / 2.0::DOUBLE - 0.5::DOUBLE AS a, (o_orderkey % 5) / 2.0::DOUBLE + 0.5::DOUBLE + (o_custkey % 40) / 2.0::DOUBLE AS b FROM orders),
w AS (SELECT *, abs(a) <= 0.001::DOUBLE AND abs(b - e) <= 0.001::DOUBLE AS whole, greatest(0, least(1, (t - a) / 1.5::DOUBLE)) AS setup, greatest(0, least(1, b - t)) AS tail FROM v)
SELECT id, round(CASE WHEN a < 0 OR b > e THEN 0 WHEN t IS NULL THEN CASE WHEN whole THEN 1 ELSE 0.65 END WHEN t < a OR t > b THEN 0 WHEN whole THEN 1 WHEN setup < 1 OR tail < 0.5::DOUBLE THEN 0
  ELSE greatest(0, least(1, 0.45::DOUBLE + 0.2::DOUBLE * setup + 0.2::DOUBLE * tail + 0.15::DOUBLE * greatest(0, least(1, (b - a) / 3.0::DOUBLE)) - 0.15::DOUBLE)) END, 5)::DOUBLE AS integrity FROM w""")
def q_context_integrity(spark, d):
    id_, c = F.col("o_orderkey"), F.col("o_custkey")
    a = (id_ % 5) / 2 - 0.5
    o = table(spark, d, "orders").select(id_.alias("id"), F.lit(0.0).alias("s"), (4 + id_ % 31).cast("double").alias("e"), F.when(c % 7 != 0, (c % 30) / 2).alias("t"), a.alias("a"), (a + 1 + (c % 40) / 2).alias("b"))
    return o.select("id", F.round(S.context_integrity("s", "e", "t", "a", "b", fragments=2, clipped_tail=True, minimum_tail=0.5), 5).alias("integrity"))


@query("""WITH v AS (SELECT o_orderkey AS id, (o_orderkey % 21) / 20.0::DOUBLE AS c, o_orderkey % 6 = 0 AS impact, (o_custkey % 5) * 60 AS j, (o_orderkey % 4) * 90 AS l FROM orders)
SELECT id, CASE WHEN impact OR c < 0.8::DOUBLE THEN 'direct' WHEN j > 0 OR l <= 0 THEN 'j_cut' ELSE 'l_cut' END AS mode,
  CAST(CASE WHEN impact OR c < 0.8::DOUBLE THEN 0 ELSE least(250, greatest(100, CASE WHEN j > 0 THEN j WHEN l > 0 THEN l ELSE 100 END)) END AS INTEGER) AS ms FROM v""")
def q_audio_overlap(spark, d):
    id_ = F.col("o_orderkey")
    return table(spark, d, "orders").select(id_.alias("id"), S.audio_overlap((id_ % 21) / 20, id_ % 6 == 0, (F.col("o_custkey") % 5) * 60, (id_ % 4) * 90).alias("m")).select("id", "m.mode", "m.ms")


_SEGMENTS = "seg AS (SELECT o_orderkey AS id, 'raw/s' || (o_custkey % 30) || '.mp4' AS path, (o_orderkey % 50)::DOUBLE - 1 AS a, (o_orderkey % 50)::DOUBLE - 1 + (o_custkey % 8) / 4.0::DOUBLE AS b FROM orders)"
_CLOCK = "CAST(ms // 1000 AS BIGINT) || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0')"


def segments(spark, d):
    id_, a = F.col("o_orderkey"), (F.col("o_orderkey") % 50).cast("double") - 1
    return table(spark, d, "orders").select(id_.alias("id"), F.concat(F.lit("raw/s"), F.col("o_custkey") % 30, F.lit(".mp4")).alias("path"), a.alias("source_in"), (a + (F.col("o_custkey") % 8) / 4).alias("source_out"))


@query(f"""WITH {_SEGMENTS}, u AS (SELECT DISTINCT path, a, b FROM seg), l AS (SELECT 'raw/s' || i || '.mp4' AS path, 20 + i AS d FROM range(0, 25) AS r(i)),
j AS (SELECT u.*, d FROM u LEFT JOIN l USING (path))
SELECT path, a AS source_in, b AS source_out, rule FROM (SELECT path, a, b, unnest(list_filter([CASE WHEN d IS NULL THEN 'known' END, CASE WHEN NOT (a >= 0 AND b > a) THEN 'range' END, CASE WHEN b > d + 0.02::DOUBLE THEN 'within' END], lambda x: x IS NOT NULL)) AS rule FROM j)""")
def q_preflight(spark, d):
    ledger = spark.range(25).select(F.concat(F.lit("raw/s"), "id", F.lit(".mp4")).alias("path"), (F.col("id") + 20.0).alias("duration"))
    return render.preflight(segments(spark, d), ledger)


@query(f"""WITH {_SEGMENTS}, c AS (SELECT id, path, CAST(round(a * 1000) AS BIGINT) AS m, CAST(round((b - a) * 1000) AS BIGINT) AS n FROM seg WHERE a >= 0 AND b > a),
t AS (SELECT id, path, (SELECT {_CLOCK} FROM (SELECT m AS ms)) AS x, (SELECT {_CLOCK} FROM (SELECT n AS ms)) AS y FROM c)
SELECT id, 'ffmpeg -hide_banner -loglevel error -y -ss ' || x || ' -t ' || y || ' -i ' || path || ' -filter_complex [0:v:0]setpts=PTS-STARTPTS,scale=w=''min(iw,1920)'':h=''min(ih,1200)'':force_original_aspect_ratio=decrease:flags=lanczos,pad=1920:1200:(ow-iw)/2:(oh-ih)/2,setsar=1[v] -map [v] -map 0:a:0? -fps_mode passthrough -c:v libx264 -preset medium -crf 18 -pix_fmt yuv420p -c:a aac -ar 48000 -b:a 320k -t ' || y || ' out/' || id || '.mp4' AS command FROM t""")
def q_segment_commands(spark, d):
    s = segments(spark, d).withColumn("to", F.concat(F.lit("out/"), "id", F.lit(".mp4")))
    return render.segment_commands(s, "ffmpeg", "to").filter("argv is not null").select("id", F.array_join("argv", " ").alias("command"))


@query(f"""WITH v AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS g, o_orderkey % 3 = 0 AS m, CAST(1000 + o_orderkey % 977 AS BIGINT) AS ms FROM orders), t AS (SELECT *, {_CLOCK} AS d FROM v)
SELECT id, CASE WHEN g AND m THEN '[0:a:0]aresample=48000,aformat=sample_fmts=fltp:sample_rates=48000:channel_layouts=stereo,volume=-6.000dB[game_gain];[1:a:0]aresample=48000,aformat=sample_fmts=fltp:sample_rates=48000:channel_layouts=stereo,volume=-14.000dB[music_gain];[game_gain]asplit=2[game_sidechain][game_mix];[music_gain][game_sidechain]sidechaincompress=threshold=0.04:ratio=2.4:attack=50:release=500:makeup=1[ducked_music];[game_mix][ducked_music]amix=inputs=2:duration=first:dropout_transition=0,aresample=48000:async=1:first_pts=0,loudnorm=I=-16.0:TP=-2.0,apad=whole_dur=' || d || ',atrim=duration=' || d || '[aout]'
  WHEN g THEN '[0:a:0]aresample=48000,aformat=sample_fmts=fltp:sample_rates=48000:channel_layouts=stereo,volume=-6.000dB,loudnorm=I=-16.0:TP=-2.0,apad=whole_dur=' || d || ',atrim=duration=' || d || '[aout]'
  WHEN m THEN '[1:a:0]aresample=48000,aformat=sample_fmts=fltp:sample_rates=48000:channel_layouts=stereo,volume=-14.000dB,loudnorm=I=-16.0:TP=-2.0,apad=whole_dur=' || d || ',atrim=duration=' || d || '[aout]'
  ELSE 'anullsrc=r=48000:cl=stereo,atrim=duration=' || d || '[aout]' END AS graph,
  '[g]aresample=48000,volume=0.000dB,acompressor=threshold=0.180:ratio=3.000:attack=8:release=140:makeup=1,alimiter=limit=0.600:attack=5:release=80:level=0[game_bus];[game_bus]asplit=2[game_sidechain][game_mix];[m]aresample=48000,atrim=duration=' || d || ',volume=-14.000dB[music_bus];[music_bus][game_sidechain]sidechaincompress=threshold=0.120:ratio=1.600:attack=50:release=500:makeup=1:mix=0.200[ducked_music];[game_mix][ducked_music]amix=inputs=2:duration=longest:dropout_transition=0:normalize=0,loudnorm=I=-14.0:TP=-1.0,aresample=48000:async=1:first_pts=0,atrim=duration=' || d || ',apad=whole_dur=' || d || '[aout]' AS mix FROM t""")
def q_audio_graphs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), ((1000 + F.col("o_orderkey") % 977) / 1000).alias("d"))
    return o.select("id", render.audio_graph(F.col("id") % 2 == 0, F.col("id") % 3 == 0, "d").alias("graph"), render.edit_mix("g", "m", 0.0, -14.0, "d").alias("mix"))


_SHOTS = f"""{EVENTS_SQL}, v AS (SELECT event_id, source_id, t, confidence, row_number() OVER (PARTITION BY source_id ORDER BY t, event_id) AS ord, CASE WHEN type = 'kill' THEN t END AS anchor, CASE WHEN type = 'kill' THEN type END AS kind, CASE WHEN k % 2 = 0 THEN floor(t) END AS target FROM ev)"""


def placed(spark, d):
    """Every source's events as an edit: four seconds each, from half a second before to three and a half after."""
    from pyspark.sql import Window

    e = events(spark, d)
    kill = F.when(F.col("type") == "kill", 1)
    v = e.select("source_id", F.col("event_id").cast("string").alias("variant_id"), (F.col("t") - 0.5).alias("source_in"), (F.col("t") + 3.5).alias("source_out"), (F.col("t") * kill).alias("anchor_t"), F.when(kill == 1, F.col("type")).alias("anchor_type"), F.when(F.col("k") % 2 == 0, F.floor("t").cast("double")).alias("target"), F.col("confidence").alias("context"))
    w = Window.partitionBy("source_id").orderBy("t", "event_id")
    p = e.select("source_id", F.col("event_id").cast("string").alias("variant_id"), F.row_number().over(w).alias("ord"))
    p = p.withColumn("timeline_in", (F.col("ord") - 1) * 4.0).withColumn("timeline_out", F.col("ord") * 4.0)
    return reports.shots(p, v, ["source_id"], 7.0)


@query(f"""WITH {_SHOTS}, s AS (SELECT *, (ord - 1) * 4.0::DOUBLE AS i, 7 + (ord - 1) * 4.0::DOUBLE AS hint FROM v), g AS (SELECT *, CASE WHEN anchor IS NULL THEN hint ELSE coalesce(target, hint) END AS aim FROM s)
SELECT source_id, CAST(ord AS INTEGER) AS ord, CAST(event_id AS VARCHAR) AS variant_id, round(t - 0.5::DOUBLE, 6) AS source_in, round(t + 3.5::DOUBLE, 6) AS source_out, i AS timeline_in, i + 4 AS timeline_out, kind AS anchor_type, round(i + least(4, greatest(0, anchor - (t - 0.5::DOUBLE))), 5) AS event_timeline, round(aim, 6) AS music_target, round(aim - hint, 5) AS event_sync, round(aim - hint, 5) AS cut_sync, round(CASE WHEN anchor IS NULL THEN confidence ELSE 1 END, 6)::DOUBLE AS context, 'hard_cut' AS transition FROM g""")
def q_shots(spark, d):
    s = placed(spark, d)
    return s.select("source_id", "ord", "variant_id", r6("source_in"), r6("source_out"), "timeline_in", "timeline_out", "anchor_type", F.round("event_timeline", 5).alias("event_timeline"), r6("music_target"), F.round("event_sync", 5).alias("event_sync"), F.round("cut_sync", 5).alias("cut_sync"), r6("context"), "transition")


_MMSS = "lpad(CAST(ms // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0')"


@query(f"""WITH {_SHOTS}, s AS (SELECT *, CAST((ord - 1) * 4000 AS BIGINT) AS x, CAST(ord * 4000 AS BIGINT) AS y, max(ord) OVER (PARTITION BY source_id) AS last FROM v),
p AS (SELECT *, (ord - 1)::DOUBLE / last AS share FROM s)
SELECT source_id, CAST(ord AS INTEGER) AS ord, (SELECT {_MMSS} FROM (SELECT x AS ms)) || '-' || (SELECT {_MMSS} FROM (SELECT y AS ms)) || ' ' || rpad(CASE WHEN share >= 0.85::DOUBLE THEN 'finale' WHEN share < 0.2::DOUBLE THEN 'build' WHEN share < 0.45::DOUBLE THEN 'rise' WHEN share < 0.6::DOUBLE THEN 'release' ELSE 'escalation' END, 10, ' ') || ' ' || event_id || ' ' || coalesce(kind, 'no-payoff') AS line FROM p""")
def q_edit_lines(spark, d):
    from pyspark.sql import Window

    s = placed(spark, d).withColumn("last", F.max("timeline_out").over(Window.partitionBy("source_id")))
    return sinks.edit_lines(s.withColumn("section", S.section("timeline_in", "last")), ["source_id"])


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 10 / 10.0::DOUBLE END AS audio, CASE WHEN o_custkey % 2 = 1 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS motion, NULL::DOUBLE AS unseen FROM orders""")
def q_flattened(spark, d):
    c = F.col("o_custkey")
    first = F.when(c % 2 == 0, F.create_map(F.lit("audio"), c % 10 / 10, F.lit("motion"), F.lit(0.5)))
    second = F.create_map(F.lit("motion"), F.lit(0.25))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), first.alias("features"), second.alias("penalties"))
    return sinks.flattened(o, ["id"], ["features", "penalties"], ["unseen", "motion", "audio"])


@query(f"""WITH {EVENTS_SQL} SELECT source_id, count(*) AS event_count, CAST(to_json(list({{'t': CAST(floor(t * 1000) AS BIGINT), 'event_id': event_id, 'type': type}} ORDER BY floor(t * 1000), event_id)) AS VARCHAR) AS events FROM ev GROUP BY source_id""")
def q_event_document(spark, d):
    e = events(spark, d).select("source_id", F.floor(F.col("t") * 1000).alias("t"), "event_id", "type")
    return sinks.event_document(e, ["source_id"])


@query(f"""WITH {EVENTS_SQL} SELECT event_id, round(t, 6) AS t, 'confidence' AS series, round(confidence, 6) AS value FROM ev UNION ALL SELECT event_id, round(t, 6), 'strength', round(strength, 6) FROM ev""")
def q_plot_table(spark, d):
    long = sinks.plot_table(events(spark, d), ["event_id"], "t", ["confidence", "strength"])
    return long.select("event_id", r6("t"), "series", r6("value"))


@query(f"""WITH {EVENTS_SQL}, d AS (SELECT source_id, floor(t) AS f FROM ev WHERE type = 'kill' GROUP BY ALL), g AS (SELECT source_id, floor(t) AS f FROM ev WHERE type = 'objective' GROUP BY ALL),
s AS (SELECT DISTINCT source_id FROM ev WHERE type IN ('kill', 'objective')),
c AS (SELECT CAST(source_id AS VARCHAR) AS key, (SELECT count(*) FROM d JOIN g USING (source_id, f) WHERE d.source_id = s.source_id) AS tp, (SELECT count(*) FROM d WHERE d.source_id = s.source_id) AS n, (SELECT count(*) FROM g WHERE g.source_id = s.source_id) AS m FROM s),
a AS (SELECT key, tp, n - tp AS fp, m - tp AS fn FROM c UNION ALL SELECT 'ALL', sum(tp), sum(n - tp), sum(m - tp) FROM c)
SELECT key, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6)::DOUBLE AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6)::DOUBLE AS recall FROM a""")
def q_gold_metrics(spark, d):
    """Whole hours as times, so that what matches is what is equal."""
    hours = lambda kind: events(spark, d).filter(f"type = '{kind}'").select("source_id", F.floor("t").cast("double").alias("t")).distinct()
    out = reports.gold_metrics(hours("kill"), hours("objective"), "source_id", "t", 0.25)
    return out.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT event_id, source_id, confidence, semantic, strength, t, k FROM ev)
SELECT event_id, 'neutral' AS motion_direction, 0.5::DOUBLE AS motion_strength, 0.25::DOUBLE AS confidence, CASE WHEN k % 3 = 0 THEN 'ads' ELSE 'unknown' END AS ads_state, CAST(source_id AS VARCHAR) AS source_signature FROM e""")
def q_boundary_alone(spark, d):
    """Descriptors of edges that no sample is near."""
    s = events(spark, d).select("source_id", "event_id", F.col("t").alias("source_out"), F.when(F.col("k") % 3 == 0, "Scoped").otherwise("hip").alias("view"), F.col("source_id").cast("string").alias("source"))
    far = events(spark, d).select("source_id", (F.col("t") + 10_000).alias("t"), *[F.lit(0.9).alias(c) for c in ("motion", "brightness", "visual", "audio", "activity")])
    out = reports.boundary(s, far, "source_id", ["event_id"], "source_out")
    return out.select("event_id", "descriptor.motion_direction", "descriptor.motion_strength", "descriptor.confidence", "descriptor.ads_state", "descriptor.source_signature")


@query("""WITH c AS (SELECT doc_id, n_chars, '/lib/' || lang || '/' || doc_id || '.mp4' AS file_path FROM documents)
SELECT file_path, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN 'reuse' ELSE 'probe' END AS action FROM c""")
def q_incremental_index(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/lib/"), "lang", F.lit("/"), "doc_id", F.lit(".mp4")).alias("file_path"), F.col("n_chars").alias("file_size"), F.timestamp_seconds("doc_id").alias("modified"))
    mark = media_index.fingerprint()
    before = c.filter("doc_id % 3 <> 0").withColumn("file_size", F.when(F.col("doc_id") % 5 == 0, F.col("file_size") + 1).otherwise(F.col("file_size"))).withColumn("fingerprint", mark)
    reuse, probe = media_index.incremental(c.withColumn("fingerprint", mark), before)
    return reuse.select("file_path", F.lit("reuse").alias("action")).unionByName(probe.select("file_path", F.lit("probe").alias("action")))


@query("""SELECT '/lib/' || lang || '/' || doc_id || '.mp4' AS file_path FROM documents WHERE lang = 'en'""")
def q_source_selection(spark, d):
    c = table(spark, d, "documents").select(F.concat(F.lit("/lib/"), "lang", F.lit("/"), "doc_id", F.lit(".mp4")).alias("file_path"))
    return media_index.select_sources(c, "/lib/en/")


@query("""WITH n AS (SELECT c_custkey AS k FROM customer), r AS (
  SELECT k, 0 AS ord, 'rule-1' AS rule_id, 'label' || k AS label, 'template_match' AS detector_type, 0.25::DOUBLE AS x1 FROM n WHERE k % 2 = 0
  UNION ALL SELECT k, 0, 'a', 'first', 'template_match', 0.1::DOUBLE FROM n WHERE k % 2 = 1
  UNION ALL SELECT k, 1, 'a-2', 'held' || k, 'counter', 0.5::DOUBLE FROM n WHERE k % 2 = 1
  UNION ALL SELECT k, 2, 'rule', 'event', 'flash', NULL FROM n WHERE k % 2 = 1)
SELECT k, CAST(ord AS INTEGER) AS ord, rule_id, label, detector_type, x1 FROM r""")
def q_workflow_rules(spark, d):
    one = F.concat(F.lit('{"schema": "x-workflow-v1", "detector": {"detector_type": "template_match", "event_label": "label'), "k", F.lit('", "roi": {"coordinate_space": "normalized", "x1": 0.25, "y1": 0, "x2": 1, "y2": 1}}}'))
    several = F.concat(F.lit('{"schema": "x-workflow-v1", "rules": [{"id": "a", "label": "first", "roi": {"x1": 0.1}}, {"id": "a", "detector": {"detector_type": "counter", "event_label": "held'), "k", F.lit('", "roi": {"x1": 0.5}}}, {"type": "flash", "event_label": "event"}]}'))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).withColumn("text", F.when(F.col("k") % 2 == 0, one).otherwise(several))
    return workflow.rules(workflow.parse(c, "text"), "k").select("k", "ord", "rule_id", "label", "detector_type", F.col("roi.x1").alias("x1"))


@query("""WITH n AS (SELECT c_custkey AS k, c_custkey % 5 AS m FROM customer)
SELECT k, rule FROM (SELECT k, unnest(list_filter([CASE WHEN m = 0 THEN 'roi' END, CASE WHEN m = 1 THEN 'space' END, CASE WHEN m = 2 THEN 'thresholds' END, CASE WHEN m = 3 THEN 'label' END, CASE WHEN k % 3 = 0 THEN 'bridge' END, CASE WHEN k % 7 = 0 THEN 'edit_rules' END], lambda x: x IS NOT NULL)) AS rule FROM n)""")
def q_workflow_violations(spark, d):
    m, k = F.col("k") % 5, F.col("k")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    text = F.concat(
        F.lit('{"schema": "x-workflow-v1", "detector": {"detector_type": "t", "event_label": '), quote(F.when(m == 3, " ").otherwise("x")),
        F.lit(', "thresholds": {"match": '), F.when(m == 2, "1.5").otherwise("0.5"), F.lit('}, "roi": {"coordinate_space": '), quote(F.when(m == 1, "pixels").otherwise("normalized")),
        F.lit(', "x1": '), F.when(m == 0, "0.9").otherwise("0.1"), F.lit(', "y1": 0.1, "x2": 0.5, "y2": 0.5}}, "edit_rules": {"event_pre_seconds": '), F.when(k % 7 == 0, "-1").otherwise("1"),
        F.lit(', "merge_gap_seconds": 2, "long_gap_bridge_seconds": '), F.when(k % 3 == 0, "3").otherwise("1"), F.lit("}}"),
    )
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).withColumn("text", text)
    return workflow.violations(workflow.parse(c, "text"), "k")


# -- pictures and sound: the 64 numbers of an embedding are an 8x8 grey picture, or 64 samples ------------------------

_BYTES = "px AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor(x * 400 + 100))) AS BIGINT)) AS p FROM embeddings)"


def pictures(spark, d):
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 400 + 100))).cast("int"))
    e = table(spark, d, "embeddings").select("vec_id", "label", grey.alias("p"))
    return e.withColumn("pixels", F.unhex(F.array_join(F.transform("p", lambda x: F.lpad(F.hex(x), 2, "0")), "")))


@query(f"""WITH {_BYTES.replace('floor(x * 400', 'floor(x::DOUBLE * 400')}, b AS (SELECT *, lag(p) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM px),
c AS (SELECT vec_id, v, count(*) AS n FROM (SELECT vec_id, unnest(p) AS v FROM px) GROUP BY ALL), h AS (SELECT vec_id, -sum(n / 64.0::DOUBLE * log2(n / 64.0::DOUBLE)) / 8 AS entropy FROM c GROUP BY vec_id)
SELECT vec_id, round(list_avg(p) / 255, 5) AS brightness, round(len(list_filter(p, lambda x: x < 8)) / 64.0::DOUBLE, 5) AS black_ratio, round(h.entropy, 5) AS entropy, round(CASE WHEN q IS NULL THEN 0 ELSE list_avg(list_transform(range(1, 65), lambda i: abs(p[i] - q[i]))) / 255 END, 5)::DOUBLE AS difference FROM b JOIN h USING (vec_id)""")
def q_frame_statistics(spark, d):
    f = media.frame_statistics(pictures(spark, d).select("vec_id", "label", "pixels"), ["label"], ["vec_id"])
    return f.select("vec_id", *[F.round(c, 5).alias(c) for c in ("brightness", "black_ratio", "entropy", "difference")])


@query(f"""WITH {_BYTES.replace('floor(x * 400', 'floor(x::DOUBLE * 400')}, b AS (SELECT vec_id, label, p[1:48] AS p, lag(p[1:48]) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM px),
c AS (SELECT vec_id, p, q, list_transform(range(0, 16), lambda i: {{'r': p[3 * i + 1], 'g': p[3 * i + 2], 'b': p[3 * i + 3], 'c': i % 4}}) AS now, list_transform(range(0, 16), lambda i: {{'r': q[3 * i + 1], 'g': q[3 * i + 2], 'b': q[3 * i + 3], 'c': i % 4}}) AS old FROM b),
s AS (SELECT *, list_transform(now, lambda x: {{'r': x.r, 'g': x.g, 'b': x.b, 'hi': greatest(x.r, x.g, x.b), 'lo': least(x.r, x.g, x.b)}}) AS m FROM c),
o AS (SELECT *, list_transform(m, lambda x: CASE WHEN x.hi = x.lo THEN 0 WHEN x.hi = x.r THEN ((x.g - x.b) / (x.hi - x.lo)::DOUBLE + 6) % 6 WHEN x.hi = x.g THEN (x.b - x.r) / (x.hi - x.lo)::DOUBLE + 2 ELSE (x.r - x.g) / (x.hi - x.lo)::DOUBLE + 4 END * 30) AS hue FROM s)
SELECT vec_id, round(CASE WHEN q IS NULL THEN 0 ELSE least(1, list_avg(list_transform(list_filter(range(1, 49), lambda i: ((i - 1) // 3) % 4 < 2), lambda i: abs(p[i] - q[i]))) / 255 * 3) END, 5)::DOUBLE AS left_half,
  round(CASE WHEN q IS NULL THEN 0 ELSE least(1, abs(list_avg(list_transform(now, lambda x: greatest(0, x.r - greatest(x.g, x.b)))) - list_avg(list_transform(old, lambda x: greatest(0, x.r - greatest(x.g, x.b))))) / 255 * 4) END, 5)::DOUBLE AS damage_border_change,
  round(len(list_filter(range(1, 17), lambda i: (hue[i] <= 18 OR hue[i] >= 170) AND m[i].hi >= 80 AND (m[i].hi - m[i].lo) * 255 >= 80 * m[i].hi)) / 16.0::DOUBLE, 5) AS orange FROM o""")
def q_frame_channels(spark, d):
    """The first 48 numbers as a colour picture of 4 by 4."""
    f = pictures(spark, d).select("vec_id", "label", F.substring("pixels", 1, 48).alias("pixels"), F.lit(4).alias("width"), F.lit(4).alias("height"))
    out = media.frame_channels(f, ["label"], ["vec_id"], {"left_half": (0.0, 0.0, 0.5, 1.0)})
    return out.select("vec_id", *[F.round(c, 5).alias(c) for c in ("left_half", "damage_border_change", "orange")])


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
f AS (SELECT vec_id, k, x[k * 8 + 1:k * 8 + 16] AS s FROM e, range(0, 7) AS r(k)),
w AS (SELECT vec_id, k, s, list_transform(range(0, 9), lambda j: sqrt(pow(list_sum(list_transform(range(0, 16), lambda n: s[n + 1] * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 15)) * cos(2 * pi() * j * n / 16))), 2) + pow(list_sum(list_transform(range(0, 16), lambda n: s[n + 1] * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 15)) * sin(2 * pi() * j * n / 16))), 2))) AS a FROM f),
l AS (SELECT *, lag(a) OVER (PARTITION BY vec_id ORDER BY k) AS b FROM w)
SELECT vec_id, round(vec_id + k * 0.1::DOUBLE, 5) AS t, round(sqrt(list_avg(list_transform(s, lambda v: v * v))), 5) AS rms, round(list_max(list_transform(s, lambda v: abs(v))), 5) AS peak, round(CASE WHEN b IS NULL THEN 0 ELSE list_avg(list_transform(range(1, 10), lambda j: greatest(0, a[j] - b[j]))) END, 4)::DOUBLE AS flux FROM l""")
def q_waveform(spark, d):
    """64 samples at 80 a second, frames of 16 with half overlap."""
    c = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("double").alias("start_s"), "embedding")
    out = media.waveform_features(c, ["vec_id"], "embedding", 80, 0.2)
    return out.select("vec_id", F.round("t", 5).alias("t"), F.round("rms", 5).alias("rms"), F.round("peak", 5).alias("peak"), F.round("flux", 4).alias("flux"))


@query("""WITH RECURSIVE b AS (SELECT vec_id AS frame, i AS id, (i * 37 + vec_id * 11) % 61 + i / 8.0::DOUBLE AS x, floor(embedding[i]::DOUBLE * 400) AS y, 5.0::DOUBLE + i % 3 AS size FROM embeddings, range(1, 13) AS r(i)),
o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY y, id) AS n FROM b),
w AS (SELECT frame, id, n, y AS mean, 1 AS held, 0 AS row FROM o WHERE n = 1
  UNION ALL SELECT o.frame, o.id, o.n, CASE WHEN abs(o.y - w.mean) > 20 THEN o.y ELSE (w.mean * w.held + o.y) / (w.held + 1) END, CASE WHEN abs(o.y - w.mean) > 20 THEN 1 ELSE w.held + 1 END, CASE WHEN abs(o.y - w.mean) > 20 THEN w.row + 1 ELSE w.row END FROM w JOIN o ON o.frame = w.frame AND o.n = w.n + 1),
j AS (SELECT b.*, row, x - lag(x) OVER (PARTITION BY b.frame, row ORDER BY x) AS gap FROM w JOIN b USING (frame, id))
SELECT frame, CAST(row AS BIGINT) AS row, count(*) AS n, round(greatest(0, 1 - stddev_pop(y) / avg(size)), 5)::DOUBLE AS y_score, round(greatest(0, 1 - stddev_pop(size) / avg(size)), 5)::DOUBLE AS size_score, round(greatest(0, 1 - coalesce(stddev_pop(gap) / avg(gap), 0)), 5)::DOUBLE AS spacing_score FROM j GROUP BY frame, row""")
def q_row_geometry(spark, d):
    """Twelve detections in each frame."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), "embedding", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("id"))
    i = F.col("id")
    b = e.select("frame", i.cast("long").alias("id"), ((i * 37 + F.col("frame") * 11) % 61 + i / 8).alias("x"), F.floor(F.get("embedding", i - 1).cast("double") * 400).cast("double").alias("y"), (5.0 + i % 3).alias("size"))
    out = media.row_geometry(selection.row_groups(b, ["frame"], "y", 20.0, ["id"]), ["frame"])
    return out.select("frame", F.col("row").cast("long").alias("row"), "n", *[F.round(c, 5).alias(c) for c in ("y_score", "size_score", "spacing_score")])


# -- indexes, reports, guards ---------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '/lib/raw/a/b.mp4' WHEN 1 THEN '/lib/raw/../x/b.mp4' WHEN 2 THEN '/lib//raw/./c/../b.mp4' WHEN 3 THEN '/lib/rawest/b.mp4' WHEN 4 THEN '/lib/x/../raw' ELSE '/../../lib/raw/b.mp4' END AS path FROM orders)
SELECT id, id % 6 NOT IN (1, 3) AS inside FROM p""")
def q_path_guard(spark, d):
    id_ = F.col("o_orderkey")
    paths = F.array(*map(F.lit, ("/lib/raw/a/b.mp4", "/lib/raw/../x/b.mp4", "/lib//raw/./c/../b.mp4", "/lib/rawest/b.mp4", "/lib/x/../raw", "/../../lib/raw/b.mp4")))
    return table(spark, d, "orders").select(id_.alias("id"), media_index.is_within(F.get(paths, (id_ % 6).cast("int")), "/lib/raw/").alias("inside"))


@query("""WITH t AS (SELECT s_suppkey AS ord, '/bin/t' || s_suppkey AS path, CASE WHEN s_suppkey % 5 = 0 THEN 'N-' || s_suppkey ELSE (s_suppkey % 3) || '.' || (s_suppkey % 12) END AS version, s_suppkey % 2 = 0 AS h264, s_suppkey % 4 = 0 AS hevc FROM supplier),
r AS (SELECT *, CASE WHEN ord % 5 = 0 THEN [0] ELSE [ord % 3, ord % 12] END AS v FROM t)
SELECT path, version, h264, hevc, CASE WHEN h264 THEN 'highest version that runs, with a hardware encoder' ELSE 'highest version that runs; software encoding' END AS reason FROM r ORDER BY v DESC, h264 DESC, hevc DESC, ord LIMIT 1""")
def q_tool_pick(spark, d):
    k = F.col("s_suppkey")
    version = F.when(k % 5 == 0, F.concat(F.lit("N-"), k)).otherwise(F.concat(k % 3, F.lit("."), k % 12))
    t = table(spark, d, "supplier").select(k.alias("ord"), F.concat(F.lit("/bin/t"), k).alias("path"), version.alias("version"), (k % 2 == 0).alias("h264"), (k % 4 == 0).alias("hevc"))
    return render.pick_tool(t)


@query("""SELECT doc_id, 'ffmpeg -hide_banner -loglevel error -y -i /lib/' || doc_id || '.mp4 -map 0:v:0 -map 0:a:0? -vf scale=640:360:force_original_aspect_ratio=decrease:flags=fast_bilinear,pad=640:360:(ow-iw)/2:(oh-ih)/2 -fps_mode passthrough -c:v libx264 -preset veryfast -crf 30 -c:a aac -ac 1 -ar 22050 -b:a 96k proxy/' || doc_id || '.mp4' AS command FROM documents WHERE n_chars > 300""")
def q_proxy_commands(spark, d):
    r = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/lib/"), "doc_id", F.lit(".mp4")).alias("file_path"), F.col("n_chars").cast("double").alias("duration"))
    made = render.proxy_commands(r, "ffmpeg", F.concat(F.lit("proxy/"), "doc_id", F.lit(".mp4")))
    return made.filter("argv is not null").select("doc_id", F.array_join("argv", " ").alias("command"))


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT source_id, bool_and(t >= 5) AS ranges, bool_and(confidence >= 0.01::DOUBLE) AS integrity, count(CASE WHEN k > 3 THEN k END) = count(DISTINCT CASE WHEN k > 3 THEN k END) AS dedupe FROM ev GROUP BY source_id),
p AS (SELECT c_custkey AS source_id, c_custkey % 3 > 0 AS streams, c_custkey % 4 > 0 AS size, c_custkey % 5 > 0 AS cadence, c_custkey % 7 > 0 AS length, c_custkey % 2 > 0 AS decoded FROM customer),
j AS (SELECT p.*, coalesce(ranges, false) AS ranges, coalesce(integrity, false) AS integrity, coalesce(dedupe, false) AS dedupe FROM p LEFT JOIN g USING (source_id))
SELECT *, streams AND size AND cadence AND length AND decoded AND ranges AND integrity AND dedupe AS valid FROM j""")
def q_output_checks(spark, d):
    e = events(spark, d)
    shots = e.select("source_id", (F.col("t") - 5).alias("source_in"), F.col("t").alias("source_out"), F.col("confidence").alias("context"), F.when(F.col("k") > 3, F.col("k")).alias("duplicate_group"))
    c = F.col("c_custkey")
    probe = table(spark, d, "customer").select(
        c.alias("source_id"), F.lit(True).alias("has_video"), (c % 3 > 0).alias("has_audio"), F.when(c % 4 > 0, 1920).otherwise(1280).alias("width"), F.lit(1200).alias("height"),
        F.when(c % 5 > 0, 59.0).otherwise(50.0).alias("fps"), F.when(c % 7 > 0, 60.0).otherwise(61.0).alias("duration"), (c % 2 > 0).alias("decoded"),
    )
    return reports.output_checks(probe, shots, ["source_id"], 1920, 1200, 60.0, (45.0, 60.0), 0.01)


def truth_tables(spark, d):
    from ..operators.events import sequences

    found = events(spark, d).filter("type = 'kill'").select("source_id", "event_id", "t")
    records = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.lit(1920).alias("width"), F.lit(1200).alias("height"))
    c = F.col("source_id")
    results = records.filter("source_id % 3 > 0").select("source_id", F.when(c % 10 == 1, "PARTIAL_ERROR").otherwise("OK").alias("status"), F.lit("p").alias("profile_id"), (c * 12).alias("frames_scanned"), (c % 5).alias("dense_frames_scanned"), (c % 2).alias("requests"), F.when(c % 10 == 1, 1).otherwise(0).alias("errors"))
    return results, records, found, sequences(found, ["source_id"], "t", 6.0)


_TRUTH = f"""{EVENTS_SQL}, f AS (SELECT source_id, event_id, t, t - lag(t) OVER (PARTITION BY source_id ORDER BY t, event_id) AS d FROM ev WHERE type = 'kill'),
q AS (SELECT source_id, count(*) AS n, sum(CASE WHEN d <= 6 THEN 0 ELSE 1 END) AS s FROM f GROUP BY source_id),
src AS (SELECT c_custkey AS source_id, 1920 AS width, 1200 AS height, CASE WHEN c_custkey % 3 = 0 THEN 'UNPROFILED' WHEN c_custkey % 10 = 1 THEN 'PARTIAL_ERROR' ELSE 'OK' END AS status, CASE WHEN c_custkey % 3 > 0 THEN 'p' END AS profile_id,
  CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 12 ELSE 0 END AS frames_scanned, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 5 ELSE 0 END AS dense_frames_scanned, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 2 ELSE 0 END AS requests, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 10 = 1 THEN 1 ELSE 0 END AS errors,
  coalesce(n, 0) AS events, CAST(coalesce(s, 0) AS BIGINT) AS sequences FROM customer LEFT JOIN q ON q.source_id = c_custkey)"""


@query(f"WITH {_TRUTH} SELECT * FROM src")
def q_truth_sources(spark, d):
    return reports.truth_index(*truth_tables(spark, d))[1]


@query(f"""WITH {_TRUTH}, g AS (SELECT source_id, sum(CASE WHEN d <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY t, event_id) AS s FROM f), z AS (SELECT source_id, s, count(*) AS n FROM g GROUP BY ALL),
k AS (SELECT CASE WHEN n = 1 THEN 'SINGLE_KILL' WHEN n = 2 THEN 'DOUBLE_KILL' WHEN n = 3 THEN 'TRIPLE_KILL' WHEN n = 4 THEN 'QUAD_KILL' ELSE 'MULTI_5_PLUS' END AS kind, count(*) AS n FROM z GROUP BY ALL)
SELECT count(*) AS source_count, count(*) FILTER (status <> 'UNPROFILED') AS scanned_source_count, count(*) FILTER (status = 'UNPROFILED') AS unprofiled_source_count, count(*) FILTER (status = 'PARTIAL_ERROR') AS error_source_count, CAST(sum(events) AS BIGINT) AS event_count, CAST(sum(sequences) AS BIGINT) AS sequence_count,
  'PARTIAL_ERROR' AS status, round((SELECT min(d) FROM f), 6) AS shortest_interval, (SELECT '{{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}}' FROM k) AS sequence_kinds, 'STOP_PENDING_RESOLUTION_PROFILES_AND_GOLD_SET' AS stop FROM src""")
def q_truth_report(spark, d):
    results, records, found, runs = truth_tables(spark, d)
    envelope, _ = reports.truth_index(results, records, found, runs)
    return reports.truth_report(envelope, found, runs).withColumn("shortest_interval", F.round("shortest_interval", 6))


@query(f"""WITH {EVENTS_SQL}, v AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY t, event_id) AS ord, 's' || source_id AS source, event_id % 50 AS a, k % 7 + 1 AS len, CASE WHEN k % 2 = 0 THEN 'g' || k END AS grp, CASE WHEN k % 3 = 0 THEN 'fade' ELSE 'hard_cut' END AS tr, (k % 9)::DOUBLE / 1000 AS sync FROM ev),
o AS (SELECT source_id, count(*) AS n, sum(len) AS s, avg(len) AS mean, min(len) AS least, max(len) AS most, avg(sync) * 1000 AS off, quantile_disc(sync, 0.95) * 1000 AS late FROM v GROUP BY source_id),
c AS (SELECT source_id, tr, count(*) AS n, row_number() OVER (PARTITION BY source_id ORDER BY tr) AS p FROM v WHERE ord > 1 GROUP BY source_id, tr),
l AS (SELECT source_id, 0 AS s, 0 AS p, '## Selection' AS line FROM o UNION ALL SELECT source_id, 0, 1, printf('%d shots, %.3f s.', n, s::DOUBLE) FROM o
  UNION ALL SELECT source_id, 1, -1, '## Shots' FROM o UNION ALL SELECT source_id, 1, ord, printf('- %s [%.3f, %.3f] score %.3f', source, a::DOUBLE, (a + len)::DOUBLE, 0.5::DOUBLE) FROM v
  UNION ALL SELECT source_id, 2, -1, '## Duplicate groups' FROM o UNION ALL SELECT source_id, 2, ord, '- ' || coalesce(grp, 'none') || ': ' || source FROM v
  UNION ALL SELECT source_id, 3, 0, '## Lengths' FROM o UNION ALL SELECT source_id, 3, 1, printf('Average %.3f s, shortest %.3f s, longest %.3f s.', round(mean, 3), least::DOUBLE, most::DOUBLE) FROM o
  UNION ALL SELECT source_id, 4, -1, '## Transitions' FROM o UNION ALL SELECT source_id, 4, p, printf('- %s: %d', tr, n) FROM c
  UNION ALL SELECT source_id, 5, 0, '## Beat offsets' FROM o UNION ALL SELECT source_id, 5, 1, printf('Mean %.2f ms, P95 %.2f ms.', round(off, 2), round(late, 2)) FROM o)
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY s, p) AS INTEGER) AS ord, line FROM l""")
def q_preview_report(spark, d):
    from pyspark.sql import Window

    k, a = F.col("k"), (F.col("event_id") % 50).cast("double")
    s = events(spark, d).select(
        "source_id", F.row_number().over(Window.partitionBy("source_id").orderBy("t", "event_id")).alias("ord"), F.concat(F.lit("s"), "source_id").alias("source"), a.alias("source_in"), (a + k % 7 + 1).alias("source_out"),
        (k % 7 + 1).cast("double").alias("duration"), F.lit(0.5).alias("score"), F.when(k % 2 == 0, F.concat(F.lit("g"), k)).alias("duplicate_group"), ((k % 9) / 1000).alias("sync"), F.when(k % 3 == 0, "fade").otherwise("hard_cut").alias("transition"),
    )
    return reports.preview_report(s, ["source_id"])
