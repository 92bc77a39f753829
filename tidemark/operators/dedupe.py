"""Perceptual duplicates: similar pairs, forced pairs, components, representatives."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .tables import numbered, shared_dir


def _cuts(rows: int, most: int) -> tuple[list[int], int]:
    """Borders of segments, and bits that may differ within one, for the least work on so many rows.

    Hashes that differ in d bits differ in at most d // m bits of one of m segments. More segments are fewer values to look up,
    shorter ones are shared by more rows."""

    def work(m: int) -> float:
        wide, r = S.HASH_BITS / m, most // m
        values = sum(math.comb(round(wide), k) for k in range(r + 1))
        return rows * m * values + rows * rows / 2 * min(1.0, m * values / 2**wide)

    m = min(range(1, most + 2), key=work)
    return [S.HASH_BITS * k // m for k in range(m + 1)], most // m


def similar_pairs(hashes: DataFrame, id_col: str, hash_col: str, threshold: float) -> DataFrame:
    """(a, b, similarity), a before b, of 56-bit hashes at least `threshold` alike; exact, by multi-index hashing.

    Rows meet where a segment of one is within a few bits of the other's (as many as `_cuts` says, by the number of rows); a pair is kept at the
    first segment it meets in. For few rows or low thresholds that is no better than pairing all; for many it
    is. Values that very many rows share are split by the join's skew handling."""
    most = int((1 - threshold) * S.HASH_BITS + 1e-9)
    rows = hashes.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).filter("id is not null and h is not null")
    borders, radius = _cuts(rows.count(), most)
    cuts = list(zip(borders, borders[1:]))
    segment = lambda h, a, b: F.shiftright(h, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint"))
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(b - a).alias("w"), segment(F.col("h"), a, b).alias("v")) for k, (a, b) in enumerate(cuts)])
    dealt = rows.select("id", "h", F.explode(parts).alias("s")).select("id", "h", "s.*")
    probes = turned = dealt.withColumn("top", F.lit(-1))
    for _ in range(radius):  # values with one more bit turned, above the ones before
        more = turned.select("*", F.explode(F.when(F.col("top") + 1 < F.col("w"), F.sequence(F.col("top") + 1, F.col("w") - 1))).alias("bit"))
        turned = more.select("id", "h", "k", "w", F.expr("v ^ shiftleft(1L, bit)").alias("v"), F.col("bit").alias("top"))
        probes = probes.unionByName(turned)
    a, b = dealt.alias("a"), probes.alias("b")
    met = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.id") < F.col("b.id")))
    apart = F.col("a.h").bitwiseXOR(F.col("b.h"))
    near = F.array(*[F.bit_count(segment(apart, lo, hi)) <= radius for lo, hi in cuts])
    first = met.filter(F.array_position(near, True) == F.col("a.k") + 1)
    sim = S.hamming_similarity(F.col("a.h"), F.col("b.h"))
    return first.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), sim.alias("similarity")).filter(F.col("similarity") >= threshold)


def forced_reason(strict, same_source_overlap, same_source_events, same_parent, overlap, events):
    """The reason, by priority, for which two variants are duplicates whatever their pictures; null without one."""
    return (
        F.when(strict & same_source_overlap, "same_source_overlap")
        .when(strict & same_source_events, "same_source_event_window_overlap")
        .when(same_parent & overlap, "same_parent_source_overlap")
        .when(same_parent & events, "same_parent_event_window_overlap")
    )


def _cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame, id_col: str = "id", rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id each node is connected to. Labels spread to neighbours and are followed once a
    round; each round is cut by a checkpoint, and one counter reaches the driver."""
    both = _cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct())
    labels = _cut(nodes.select(F.col(id_col).alias("id"), F.col(id_col).alias("component")))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        up = step.select(F.col("id").alias("p"), F.col("component").alias("pc"))
        jumped = step.join(up, step["component"] == up["p"]).select("id", F.col("pc").alias("component"))
        after = _cut(jumped)
        moved = after.join(labels.withColumnRenamed("component", "old"), "id").filter("component <> old").limit(1).count()
        labels = after
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def groups(labelled: DataFrame, prefix: str = "dg-", digits: int = 3) -> DataFrame:
    """Adds duplicate_group, numbered by the smallest id, and uniqueness, one over the group's size. Numbering is of the
    groups' labels alone, by ranges."""
    sizes = numbered(labelled.groupBy("component").agg(F.count("*").alias("_size")), ["component"], "_number")
    named = sizes.select("component", "_size", F.format_string(f"{prefix}%0{digits}d", F.col("_number")).alias("duplicate_group"))
    return labelled.join(named, "component").withColumn("uniqueness", 1 / F.col("_size")).drop("_size")


def representatives(df: DataFrame, group: str, id_col: str, order: list, out: str) -> DataFrame:
    """(group, out): the member that comes first by `order`, then by id."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order, F.asc(id_col)))
    return df.withColumn("_n", n).filter("_n = 1").select(group, F.col(id_col).alias(out))


def fast_order(df: DataFrame, group: str) -> tuple[DataFrame, list]:
    """The order of fast representatives: verified counts and density lead only where a member of the group has a count."""
    counted = F.max(F.col("verified_kill_count").isNotNull().cast("int")).over(Window.partitionBy(group)) == 1
    marked = df.withColumn("_v", F.when(counted, F.coalesce("verified_kill_count", F.lit(0.0))).otherwise(0.0)).withColumn("_d", F.when(counted, F.coalesce("kill_density", F.lit(0.0))).otherwise(0.0))
    return marked, [F.desc(c) for c in ("_v", "_d", "human_selection_prior", "payoff_score", "context_integrity", "final_score")] + [F.asc("duration")]


FULL_ORDER = ("payoff_score", "context_integrity", "final_score", "duration")


def full_order() -> list:
    return [F.desc(c) for c in FULL_ORDER]
