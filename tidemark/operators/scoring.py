"""Scores of candidates and variants, penalties, selection orders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

# Default weights.
CANDIDATE_WEIGHTS: dict[str, float] = {"human_selection_prior": 0.30, "combat_intensity": 0.20, "motion": 0.10, "audio_activity": 0.10, "visual_activity": 0.10, "continuity": 0.10, "uniqueness": 0.10}
VARIANT_WEIGHTS: dict[str, float] = {"payoff_score": 0.25, "human_selection_prior": 0.15, "combat_intensity": 0.12, "action_density": 0.12, "continuity": 0.10, "visual_novelty": 0.08, "motion": 0.06, "audio_activity": 0.05, "danger_score": 0.04, "uniqueness": 0.03}
MAX_RAPID_BONUS = 0.18


def weighted(weights: Mapping[str, float], round_terms: bool = False) -> Column:
    """The sum of weight times clamped column; each term rounded to six digits first if asked."""
    terms = [S.clamp(F.coalesce(F.col(k), F.lit(0.0))) * F.lit(float(w)) for k, w in weights.items()]
    terms = [F.round(t, 6) for t in terms] if round_terms else terms
    return sum(terms[1:], terms[0])


def score_candidates(df: DataFrame, weights: Mapping[str, float] = CANDIDATE_WEIGHTS) -> DataFrame:
    return df.withColumn("final_score", F.round(weighted(weights), 6))


def penalties(features: str | Column | Mapping[str, Column], payoff: Column) -> dict[str, Column]:
    """Editorial penalties of features, given as columns by name or as a map column; a moment with a payoff is forgiven most of them."""

    def one(name: str) -> list[Column]:
        if isinstance(features, Mapping):
            return [features[name]] if name in features else []
        return [F.try_element_at(S.col(features), F.lit(name))]

    def get(*names: str) -> Column:
        return S.clamp(F.coalesce(*[c for n in names for c in one(n)], F.lit(0.0)))

    paid = F.when(payoff, 1.0).otherwise(0.0)
    still = get("stationary_ads") * (1 - get("motion")) * (1 - get("visual_novelty", "visual_activity")) * (1 - get("danger_escalation", "danger_score"))
    return {
        "stationary_ads_penalty": F.when(payoff, 0.0).otherwise(still),
        "same_view_penalty": get("same_view", "same_view_run") * (1 - 0.5 * get("motion")),
        "downtime_penalty": get("downtime", "downtime_run") * (1 - 0.65 * paid),
        "no_payoff_penalty": F.when(payoff, 0.0).otherwise(0.12),
        "repetitive_fire_penalty": get("repetitive_fire", "repetitive_fire_run") * (1 - 0.75 * paid),
        "same_source_recent_penalty": get("same_source_recent"),
        "same_environment_recent_penalty": get("same_environment_recent"),
    }


def with_penalties(df: DataFrame, features: str | Mapping[str, Column], payoff: Column, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Adds one column per penalty, clamped, weighted and rounded, and their sum."""
    weights = weights or {}
    made = {k: F.round(S.clamp(v) * F.lit(float(weights.get(k.removesuffix("_penalty"), 1.0))), 6) for k, v in penalties(features, payoff).items()}
    out = df.withColumns(made)
    return out.withColumn("penalty", sum((F.col(k) for k in list(made)[1:]), F.col(next(iter(made)))))


def score_variants(df: DataFrame, weights: Mapping[str, float] = VARIANT_WEIGHTS, bonus: float = 0.18, quality: bool = False, count_weight: float = 0.30, density_weight: float = 0.20, target: float = 4.0) -> DataFrame:
    """Adds rapid_bonus, base_score and final_score. Needs the weighted columns, `penalty` and `rapid_score`, and for the
    quality profile verified_kill_count and rapid_kill_count, which there take part of the base score's place."""
    most = max(0.0, min(MAX_RAPID_BONUS, bonus))
    out = df.withColumn("rapid_bonus", F.round(F.least(F.lit(most), F.col("rapid_score") * most), 6))
    out = out.withColumn("base_score", S.clamp(weighted(weights, True) + F.col("rapid_bonus") - F.col("penalty")))
    if quality:
        share = min(1.0, max(0.0, count_weight) + max(0.0, density_weight))
        part = lambda c: S.clamp(F.col(c) / max(1.0, target))
        final = S.clamp(F.col("base_score") * (1 - share) + count_weight * part("verified_kill_count") + density_weight * part("rapid_kill_count"))
    else:
        final = F.col("base_score")
    return out.withColumn("final_score", F.round(final, 6)).withColumn("base_score", F.round("base_score", 6))


def selection_order(short: Column, preferred: Column, score: str, continuity: str, id_col: str) -> list[Column]:
    """Saved short clips first, others next, long saved ones last; then by falling score and continuity, and id."""
    bucket = F.when(short & preferred, 0).when(~short, 1).otherwise(2)
    return [bucket.asc(), F.desc(score), F.desc(continuity), F.asc(id_col)]


# The energy wanted at shares of the timeline, linear in between.
ENERGY_CURVE = ((0.0, 0.30), (0.20, 0.50), (0.45, 0.68), (0.60, 0.82), (0.85, 0.90), (1.0, 1.0))


def energy_target(relative: str | Column) -> Column:
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), S.col(relative)))
    out = None
    for (a, ya), (b, yb) in zip(ENERGY_CURVE, ENERGY_CURVE[1:]):
        part = ya + (x - a) / (b - a) * (yb - ya)
        out = F.when(x < b, part) if out is None else out.when(x < b, part)
    return out.otherwise(ENERGY_CURVE[-1][1])
