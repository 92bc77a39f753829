"""Queries over perceptual fingerprints: the 64 numbers of an embedding are an 8x8 grid."""

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import dedupe as O
from ..sources.tables import table
from .q_series import r6
from .registry import query

_GRID = "list_transform(range(0, 56), lambda b: CASE WHEN embedding[(b // 7) * 8 + b % 7 + 1] > embedding[(b // 7) * 8 + b % 7 + 2] THEN 1::BIGINT << (55 - b) ELSE 0::BIGINT END)"
_HASH = f"h AS (SELECT vec_id, label, CAST(list_sum({_GRID}) AS BIGINT) AS h FROM embeddings)"
_PAIRS = f"{_HASH}, pr AS (SELECT a.vec_id AS a, b.vec_id AS b, 1 - bit_count(xor(a.h, b.h)) / 56.0::DOUBLE AS similarity FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE 1 - bit_count(xor(a.h, b.h)) / 56.0::DOUBLE >= 0.75)"
_COMP = f"{_PAIRS}, e AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), reach AS (SELECT vec_id AS n, vec_id AS m FROM h UNION SELECT r.n, e.b FROM reach r JOIN e ON e.a = r.m), comp AS (SELECT n AS id, min(m) AS component FROM reach GROUP BY n)"


def hashes(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", S.dhash("embedding").alias("h"))


@query(f"WITH {_HASH} SELECT vec_id, h FROM h")
def q_dhash(spark, d):
    return hashes(spark, d).select("vec_id", "h")


@query(f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pr")
def q_hamming_pairs(spark, d):
    return O.similar_pairs(hashes(spark, d), "vec_id", "h", 0.75).select("a", "b", r6("similarity"))


def labelled(spark, d):
    h = hashes(spark, d)
    return h, O.components(h, O.similar_pairs(h, "vec_id", "h", 0.75), "vec_id")


@query(f"""WITH RECURSIVE {_COMP}, s AS (SELECT component, count(*) AS n, row_number() OVER (ORDER BY component) AS g FROM comp GROUP BY component)
SELECT id, component, 'dg-' || lpad(CAST(g AS VARCHAR), 3, '0') AS duplicate_group, round(1.0::DOUBLE / n, 6) AS uniqueness FROM comp JOIN s USING (component)""")
def q_dup_components(spark, d):
    return O.groups(labelled(spark, d)[1]).select("id", "component", "duplicate_group", r6("uniqueness"))


@query(f"""WITH RECURSIVE {_COMP}, v AS (SELECT component, id, vec_id % 7 AS payoff, label, vec_id % 3 AS cnt FROM comp JOIN h ON vec_id = id)
SELECT component, min(id) FILTER (f = 1) AS fast, min(id) FILTER (z = 1) AS "full" FROM (
  SELECT *, row_number() OVER (PARTITION BY component ORDER BY cnt DESC, payoff DESC, id) AS f, row_number() OVER (PARTITION BY component ORDER BY payoff DESC, label DESC, id) AS z FROM v) GROUP BY component""")
def q_representative(spark, d):
    h, c = labelled(spark, d)
    v = c.join(h.withColumnRenamed("vec_id", "id"), "id").select(
        "id", "component", (F.col("id") % 3).cast("double").alias("verified_kill_count"), F.lit(0.0).alias("kill_density"), F.lit(0.5).alias("human_selection_prior"),
        (F.col("id") % 7).cast("double").alias("payoff_score"), F.lit(1.0).alias("context_integrity"), F.col("label").cast("double").alias("final_score"), F.lit(6.0).alias("duration"),
    )
    marked, order = O.fast_order(v.withColumn("final_score", F.lit(0.0)), "component")
    fast = O.representatives(marked, "component", "id", order, "fast")
    return fast.join(O.representatives(v, "component", "id", O.full_order(), "full"), "component")


@query(f"""WITH {_HASH}, l AS (SELECT label, list(h ORDER BY vec_id) AS hs FROM h GROUP BY label),
p AS (SELECT a.label AS a, b.label AS b, CASE WHEN len(a.hs) <= len(b.hs) THEN a.hs ELSE b.hs END AS s, CASE WHEN len(a.hs) <= len(b.hs) THEN b.hs ELSE a.hs END AS l FROM l a JOIN l b ON a.label < b.label)
SELECT a, b, round(list_max(list_transform(range(0, len(l) - len(s) + 1), lambda o: list_avg(list_transform(range(1, len(s) + 1), lambda i: 1 - bit_count(xor(s[i], l[i + o])) / 56.0::DOUBLE)))), 6) AS similarity FROM p""")
def q_seq_similarity(spark, d):
    h = hashes(spark, d)
    lists = h.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "h"))).getField("h").alias("hs"))
    a, b = lists.select(F.col("label").alias("a"), F.col("hs").alias("x")), lists.select(F.col("label").alias("b"), F.col("hs").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(S.sequence_similarity("x", "y"), 6).alias("similarity"))


@query("""WITH s AS (SELECT vec_id, (vec_id % 40 - 4) / 2.0::DOUBLE AS duration FROM embeddings)
SELECT vec_id, CAST(CASE WHEN duration <= 0 THEN 0 ELSE greatest(1, least(16, ceil(duration / 1.5::DOUBLE))) END AS INTEGER) AS n, CAST(greatest(2, least(16, floor(duration / 2) + 1)) AS INTEGER) AS n_short,
  (vec_id % 5 = CASE WHEN duration <= 0 THEN 0 ELSE greatest(1, least(16, ceil(duration / 1.5::DOUBLE))) END) AS complete FROM s""")
def q_fingerprint_counts(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", ((F.col("vec_id") % 40 - 4) / 2).alias("duration"))
    n = S.sample_count("duration", 1.5)
    hs = F.slice(F.array(*[F.lit(k).cast("bigint") for k in range(5)]), 1, (F.col("vec_id") % 5).cast("int"))
    return s.select("vec_id", n.alias("n"), S.short_sample_count("duration").alias("n_short"), S.complete_fingerprint(hs, n).alias("complete"))
