"""Queries over scores, selections and edits."""

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import scoring as O
from ..operators import selection
from ..sources.tables import EVENTS_SQL, events, table
from .registry import query



def candidates(spark, d):
    p = table(spark, d, "part")
    price = (F.col("p_retailprice") - 900) / 1200
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), (F.col("p_size") / 50).alias("human_selection_prior"), price.alias("combat_intensity"), ((F.col("p_partkey") % 11) / 10).alias("motion"),
        ((F.col("p_partkey") % 13) / 12).alias("audio_activity"), ((F.col("p_partkey") % 17) / 16).alias("visual_activity"), ((F.col("p_partkey") % 7) / 6).alias("continuity"), (1 / (1 + F.col("p_partkey") % 3)).alias("uniqueness"),
    )


_CAND = """c AS (SELECT p_partkey AS id, p_brand AS brand, p_size / 50 AS prior, (p_retailprice - 900) / 1200 AS combat, (p_partkey % 11) / 10 AS motion, (p_partkey % 13) / 12 AS audio, (p_partkey % 17) / 16 AS visual, (p_partkey % 7) / 6 AS cont, 1 / (1 + p_partkey % 3) AS uniq FROM part),
s AS (SELECT *, 0.30::DOUBLE * greatest(0, least(1, prior)) + 0.20::DOUBLE * greatest(0, least(1, combat)) + 0.10::DOUBLE * motion + 0.10::DOUBLE * audio + 0.10::DOUBLE * visual + 0.10::DOUBLE * cont + 0.10::DOUBLE * uniq AS score FROM c)"""


@query(f"WITH {_CAND} SELECT id, round(score, 5) AS score FROM s")
def q_weighted_score(spark, d):
    return candidates(spark, d).select("id", F.round(O.weighted(O.CANDIDATE_WEIGHTS), 5).alias("score"))


@query("""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_discount * 10 AS ads, l_tax * 10 AS motion, l_quantity / 50 AS novelty, l_discount * 5 AS danger, l_tax * 8 AS fire, l_quantity / 60 AS downtime, l_discount * 7 AS same, l_returnflag = 'R' AS paid FROM lineitem),
c AS (SELECT id, paid, greatest(0, least(1, ads)) AS ads, greatest(0, least(1, motion)) AS motion, greatest(0, least(1, novelty)) AS novelty, greatest(0, least(1, danger)) AS danger, greatest(0, least(1, fire)) AS fire, greatest(0, least(1, downtime)) AS downtime, greatest(0, least(1, same)) AS same FROM f)
SELECT id, round(CASE WHEN paid THEN 0 ELSE ads * (1 - motion) * (1 - novelty) * (1 - danger) END, 5) AS stationary, round(same * (1 - 0.5::DOUBLE * motion), 5) AS same_view, round(downtime * (1 - 0.65::DOUBLE * CAST(paid AS INTEGER)), 5) AS downtime,
  CASE WHEN paid THEN 0::DOUBLE ELSE 0.12::DOUBLE END AS no_payoff, round(fire * (1 - 0.75::DOUBLE * CAST(paid AS INTEGER)), 5) AS repetitive FROM c""")
def q_penalty_score(spark, d):
    li = table(spark, d, "lineitem")
    names = {"stationary_ads": F.col("l_discount") * 10, "motion": F.col("l_tax") * 10, "visual_activity": F.col("l_quantity") / 50, "danger_score": F.col("l_discount") * 5, "repetitive_fire_run": F.col("l_tax") * 8, "downtime": F.col("l_quantity") / 60, "same_view": F.col("l_discount") * 7}
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.create_map(*[x for k, v in names.items() for x in (F.lit(k), v)]).alias("f"), (F.col("l_returnflag") == "R").alias("paid"))
    p = O.penalties("f", F.col("paid"))
    pick = {"stationary": "stationary_ads_penalty", "same_view": "same_view_penalty", "downtime": "downtime_penalty", "no_payoff": "no_payoff_penalty", "repetitive": "repetitive_fire_penalty"}
    return rows.select("id", *[F.round(p[v], 5).alias(k) for k, v in pick.items()])


_TERMS = " + ".join(f"round({w}::DOUBLE * greatest(0, least(1, {c})), 6)" for w, c in ((0.25, "combat"), (0.15, "prior"), (0.12, "combat"), (0.12, "motion"), (0.10, "cont"), (0.08, "visual"), (0.06, "motion"), (0.05, "audio"), (0.04, "audio"), (0.03, "uniq")))


@query(f"""WITH {_CAND}, v AS (SELECT *, round(least(0.18::DOUBLE, (id % 10) / 10.0::DOUBLE * 0.18::DOUBLE), 6) AS bonus FROM s)
SELECT id, bonus AS rapid_bonus, round(greatest(0, least(1, {_TERMS} + bonus - 0.05::DOUBLE)), 6) AS final_score FROM v""")
def q_variant_score(spark, d):
    c = candidates(spark, d)
    v = c.withColumns({"payoff_score": F.col("combat_intensity"), "action_density": F.col("motion"), "visual_novelty": F.col("visual_activity"), "danger_score": F.col("audio_activity"), "rapid_score": (F.col("id") % 10) / 10, "penalty": F.lit(0.05)})
    return O.score_variants(v).select("id", "rapid_bonus", "final_score")


@query(f"""WITH {_CAND}, o AS (SELECT *, id % 4 = 0 AS short, id % 20 AS secs FROM s)
SELECT brand, id, CAST(row_number() OVER (PARTITION BY brand ORDER BY CASE WHEN short AND secs <= 12 THEN 0 WHEN NOT short THEN 1 ELSE 2 END, round(score, 6) DESC, cont DESC, id) AS INTEGER) AS place FROM o""")
def q_candidate_order(spark, d):
    from pyspark.sql import Window

    c = O.score_candidates(candidates(spark, d))
    order = O.selection_order(F.col("id") % 4 == 0, F.col("id") % 20 <= 12, "final_score", "continuity", "id")
    return c.select("brand", "id", F.row_number().over(Window.partitionBy("brand").orderBy(*order)).alias("place"))


_EDIT = """c AS (SELECT p_brand AS brand, p_partkey AS id, 3 + (p_partkey % 17)::DOUBLE AS seconds, p_partkey % 23 AS grp, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS i FROM part),
walk AS (SELECT brand, 0::BIGINT AS i, 0::DOUBLE AS spent, []::BIGINT[] AS groups, NULL::BIGINT AS id, 0::DOUBLE AS used, 0::DOUBLE AS begin_at FROM c WHERE i = 1
  UNION ALL SELECT c.brand, c.i, w.spent + take, CASE WHEN take > 0 THEN list_append(w.groups, c.grp) ELSE w.groups END, c.id, take, w.spent
  FROM walk w JOIN c ON c.brand = w.brand AND c.i = w.i + 1, LATERAL (SELECT CASE WHEN list_contains(w.groups, c.grp) THEN 0 WHEN c.seconds <= 60 - w.spent + 1e-9 THEN c.seconds WHEN 60 - w.spent >= 3 THEN 60 - w.spent ELSE 0 END::DOUBLE AS take))"""


def clips(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), (3 + F.col("p_partkey") % 17).cast("double").alias("seconds"), (F.col("p_partkey") % 23).alias("grp"), (-F.col("p_size")).alias("o"))


@query(f"WITH RECURSIVE {_EDIT} SELECT brand, id, begin_at AS timeline_in, used FROM walk WHERE used > 0")
def q_greedy_edit(spark, d):
    return selection.greedy_edit(clips(spark, d), ["brand"], ["o", "id"], "seconds", "grp", 60.0).select("brand", "id", "timeline_in", "used")


def beam(spark, d):
    c = O.score_candidates(candidates(spark, d))
    v = c.select("brand", F.col("id").cast("string").alias("variant_id"), (3.0 + F.col("id") % 9).alias("duration"), "final_score", (F.col("id") % 19).cast("string").alias("duplicate_group"), (F.col("id") % 5).cast("string").alias("source"), (F.col("id") % 3).cast("string").alias("environment"))
    return selection.beam_edit(v, ["brand"], width=8, shots=(3, 8), seconds=(20.0, 30.0), expansions=None)


@query()
def q_beam_edit(spark, d):
    return beam(spark, d).withColumn("score", F.round("score", 6))


@query()
def q_validate_edit(spark, d):
    shots = beam(spark, d).withColumn("duration", F.col("timeline_out") - F.col("timeline_in")).withColumn("duplicate_group", F.col("variant_id")).withColumn("transition", F.when(F.col("ord") == 5, "fade").otherwise("hard_cut"))
    return selection.edit_violations(shots, ["brand"], 20.0, 30.0)


@query(f"""WITH {EVENTS_SQL}, u AS (SELECT *, count(*) OVER (PARTITION BY event_id // 2 * 2) AS uses FROM ev)
SELECT event_id, rule FROM (SELECT event_id, unnest(list_filter([CASE WHEN source_id >= 140 THEN 'known_source' END, CASE WHEN source_id < 140 AND NOT t BETWEEN 0 AND 600 + source_id THEN 'in_range' END, CASE WHEN k >= 95 THEN 'known_rule' END], lambda x: x IS NOT NULL)) AS rule FROM ev)""")
def q_detection_violations(spark, d):
    e = events(spark, d).withColumn("rule_id", F.concat(F.lit("r"), "k"))
    ledger = spark.range(0, 140).select(F.col("id").alias("source_id"), (F.col("id") + 600.0).alias("duration"))
    rules = spark.range(0, 95).select(F.concat(F.lit("r"), "id").alias("rule_id"))
    return selection.detection_violations(e, ledger, rules)


@query()
def q_box_suppression(spark, d):
    """All boxes of every frame; its SQL, a recursion over lists, takes too long on whole tables, so tests hold it against a plain loop."""
    return selection.suppress_hits(boxes(table(spark, d, "lineitem")), ["frame"], "score", "id").select("frame", "id")


def boxes(li):
    y = F.col("l_discount") * 400
    return li.select((F.col("l_suppkey") % 50).alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x1"), y.alias("y1"), (F.col("l_quantity") + 6 + F.col("l_linenumber")).alias("x2"), (y + 9).alias("y2"), F.col("l_extendedprice").alias("score"))


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT *, lag(type) OVER w AS pt, lag(confidence) OVER w AS pc, lag(semantic) OVER w AS ps FROM ev WINDOW w AS (PARTITION BY source_id ORDER BY t, event_id))
SELECT event_id, round(CASE WHEN confidence >= 0.5 AND pc >= 0.5 THEN 1 ELSE 0.65::DOUBLE END * (0.28::DOUBLE * CASE WHEN pt = type THEN 1 ELSE 0.35::DOUBLE END + 0.38::DOUBLE * (1 - (abs(confidence - pc) + abs(semantic - ps)) / 5) + 0.12::DOUBLE + 0.12::DOUBLE * CASE WHEN pt = type THEN 1 ELSE 0.55::DOUBLE END + 0.10::DOUBLE), 6) AS compatibility FROM e WHERE pt IS NOT NULL""")
def q_transition(spark, d):
    from pyspark.sql import Window

    side = F.struct(F.col("type").alias("motion_direction"), F.col("confidence").alias("motion_strength"), F.col("semantic").alias("luminance"), F.lit(0.5).alias("visual_tone"), F.lit(0.5).alias("weapon_motion"), F.lit(0.0).alias("impact_strength"), F.lit("x").alias("ads_state"), F.col("type").alias("environment_signature"), F.lit("s").alias("source_signature"), F.col("confidence"))
    e = events(spark, d).withColumn("b", side).withColumn("a", F.lag("b").over(Window.partitionBy("source_id").orderBy("t", "event_id"))).filter("a is not null")
    return e.select("event_id", S.transition_compatibility("a", "b").alias("compatibility"))


@query("""WITH o AS (SELECT o_orderkey AS id, (o_orderkey % 97) / 3.0::DOUBLE AS s, (o_orderkey % 97) / 3.0::DOUBLE + 4 + (o_orderkey % 31) AS e, (o_orderkey % 97) / 3.0::DOUBLE + (o_custkey % 40) / 2.0::DOUBLE AS a FROM orders),
w AS (SELECT id, s, e, a, greatest(s, a - 3) AS lo, least(e, a + 3) AS hi FROM o WHERE a <= e),
x AS (SELECT *, CASE WHEN hi - lo < 6 AND lo <> s THEN greatest(s, hi - 6) ELSE lo END AS p, CASE WHEN hi - lo < 6 AND lo = s THEN least(e, lo + 6) ELSE hi END AS q FROM w),
y AS (SELECT *, abs(p - s) <= 0.001 AND abs(q - e) <= 0.001 AS whole, greatest(0, least(1, (a - p) / 1.5)) AS setup, greatest(0, least(1, q - a)) AS tail FROM x)
SELECT id, round(p, 3) AS source_in, round(q, 3) AS source_out, round(CASE WHEN whole THEN 1 WHEN setup < 1 OR tail < 1 THEN 0 ELSE greatest(0, least(1, 0.45 + 0.2 * setup + 0.2 * tail + 0.15 * greatest(0, least(1, (q - p) / 3)))) END, 6)::DOUBLE AS integrity,
 (q - p BETWEEN 1.999 AND 10.001) AS allowed FROM y""")
def q_anchor_window(spark, d):
    o = table(spark, d, "orders")
    s = (F.col("o_orderkey") % 97) / 3
    o = o.select(F.col("o_orderkey").alias("id"), s.alias("s"), (s + 4 + F.col("o_orderkey") % 31).alias("e"), (s + (F.col("o_custkey") % 40) / 2).alias("a")).filter("a <= e")
    lo, hi = F.greatest(F.col("s"), F.col("a") - 3), F.least(F.col("e"), F.col("a") + 3)
    w = o.withColumn("w", S.anchor_window("s", "e", "a")).withColumn("p", F.when((hi - lo < 6) & (lo != F.col("s")), F.greatest(F.col("s"), hi - 6)).otherwise(lo)).withColumn("q", F.when((hi - lo < 6) & (lo == F.col("s")), F.least(F.col("e"), lo + 6)).otherwise(hi))
    return w.select("id", "w.source_in", "w.source_out", S.context_integrity("s", "e", "a", "p", "q").alias("integrity"), S.duration_allowed(F.col("q") - F.col("p"), F.lit("kill"), F.lit(""), F.lit(0.0)).alias("allowed"))


