"""Building an edit: greedy budgeted selection, bounded beam search, validation.

An edit is built from the candidates of one project, a few thousand rows at most; these operators work per project key and
order rows by a total order, so that the same edit comes out in every run. Projects are independent and run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import ENERGY_CURVE
from .streams import sorted_scan


def greedy_edit(df: DataFrame, keys: Sequence[str], order: Sequence[str], duration: str, group: str, budget: float, least_cut: float = 3.0) -> DataFrame:
    """Rows in order while they fit the budget and their group is unused; one that overflows is cut to what is left if
    that is at least `least_cut`, else skipped. A row without a group is a group of its own. Adds used (seconds taken), timeline_in."""

    def step(state, row):
        spent, groups = state or (0.0, frozenset())
        seconds, name = row
        room = budget - spent
        alone = name is None or name != name  # no group
        take = 0.0 if not alone and name in groups else seconds if seconds <= room + 1e-9 else room if room >= least_cut else 0.0
        if take <= 0:
            return (spent, groups), -1.0
        return (spent + take, groups if alone else groups | {name}), spent

    placed = sorted_scan(df, keys, order, [duration, group], step, "timeline_in", kind=_double()).filter("timeline_in >= 0")
    return placed.withColumn("used", F.least(F.col(duration), F.lit(budget) - F.col("timeline_in")))


def _double():
    from pyspark.sql import types as T

    return T.DoubleType()


# Weights of an expansion's score, ranks of points of the music, kinds of hero moments, and the name of saved short clips.
BEAM_WEIGHTS = {"highlight_quality": 0.35, "music_fit": 0.25, "transition_compatibility": 0.15, "diversity": 0.15, "energy_curve_fit": 0.10}
POINT_RANKS = {"phrase": 5.0, "downbeat": 4.5, "strong_beat": 4.0, "bar": 3.5, "beat": 2.0, "onset": 1.0}
HEROES = ("hero_play", "hero", "finale")
SHORT_CLIP = "short_clip"


@dataclass(frozen=True)
class Music:
    """One track: where the edit starts and ends in it, samples (t, energy), and points (t, type)."""

    start: float = 0.0
    end: float = 0.0
    energy: tuple[tuple[float, float], ...] = ()
    points: tuple[tuple[float, str], ...] = ()

    def energy_at(self, t: np.ndarray) -> np.ndarray:
        """The energy of the nearest sample (the earlier listed of two) between the track's least and highest; 0.5 where it has no range."""
        times, values = np.array(self.energy, float).reshape(-1, 2).T
        if not len(values) or values.max() <= values.min():
            return np.full(len(t), 0.5)
        at = np.abs(times[None, :] - t[:, None]).argmin(axis=1)
        return np.clip((values[at] - values.min()) / (values.max() - values.min()), 0.0, 1.0)

    def target(self, hint: float, strong: bool, tolerance: float) -> float:
        """The point for an anchor that would fall on `hint`: for a strong one by rank, then distance; else the nearest beat or onset.
        Further than `tolerance` the hint stays."""
        kinds = ("phrase", "downbeat", "strong_beat", "bar") if strong else ("beat", "onset")
        own = [p for p in self.points if p[1] in kinds] or list(self.points)
        if not own:
            return hint
        best = min(own, key=lambda p: (-POINT_RANKS.get(p[1], 0.0) if strong else 0.0, abs(p[0] - hint)))
        return best[0] if abs(best[0] - hint) <= tolerance else hint


#: Optional columns of a variant for beam_edit, and their values where they are absent or null.
VARIANT_DEFAULTS = {
    "anchor_type": "", "anchor_strong": False, "has_anchor": False, "condense_reason": "", "segments": 1, "context": 1.0, "penalty": 0.0, "compatibility": 0.65,
    "verified_kill_count": 0.0, "kill_density": 0.0, "human_selection_prior": 0.0,
}
_NUMBERS = ("motion_strength", "luminance", "visual_tone", "weapon_motion", "impact_strength")
_STATES = (("motion_direction", 0.28, 0.35), ("ads_state", 0.12, 0.45), ("environment_signature", 0.12, 0.55), ("source_signature", 0.10, 0.7))


def _likeness(tail: dict, heads: dict[str, np.ndarray]) -> np.ndarray:
    """functions.scalar.transition_compatibility of the end of one variant and the starts of all."""
    apart = sum(np.abs(heads[n] - tail[n]) for n in _NUMBERS)
    score = 0.38 * (1 - apart / 5) + sum(w * np.where(heads[n] == tail[n], 1.0, other) for n, w, other in _STATES)
    sure = (heads["confidence"] >= 0.5) & (tail["confidence"] >= 0.5)
    return np.round(np.clip(np.where(sure, score, 0.65 * score), 0.0, 1.0), 6)


class _Search:
    """The beam search over the variants of one project, given as a frame."""

    def __init__(self, pdf: pd.DataFrame, rules: dict):
        self.__dict__.update(rules)
        table = pdf.copy()
        for name, value in VARIANT_DEFAULTS.items():
            table[name] = value if name not in table else table[name].where(table[name].notna(), value)
        heroes = table["anchor_type"].isin(HEROES)
        table["is_hero"] = heroes | table["is_hero"].eq(True) if "is_hero" in table else heroes
        table["has_anchor"] = table["has_anchor"].astype(bool) | (table["anchor_type"] != "")
        saved = (table["environment"] == SHORT_CLIP) & (table["segments"] == 1) & (table["condense_reason"] == "") & (table["duration"] <= self.short + 0.001)
        table["preserved"] = saved | table["preserved"].eq(True) if "preserved" in table else saved
        by = ["final_score", "verified_kill_count", "kill_density", "human_selection_prior", "variant_id"]
        table = table.sort_values(by, ascending=[False] * 4 + [True]).reset_index(drop=True)
        column = lambda name, kind=float: table[name].to_numpy(kind)
        self.ids = table["variant_id"].tolist()
        self.by_id = np.argsort(np.argsort(np.array(self.ids)))
        self.final, self.duration, self.context, self.penalty = map(column, ("final_score", "duration", "context", "penalty"))
        self.hero, self.preserved, self.anchor, self.strong = (column(n, bool) for n in ("is_hero", "preserved", "has_anchor", "anchor_strong"))
        # a row without a group, source or environment shares it with no other
        lone = lambda name: np.where(table[name].notna(), pd.factorize(table[name])[0], -1 - np.arange(len(table)))
        self.group, self.source, self.environment = map(lone, ("duplicate_group", "source", "environment"))
        self.long = (self.duration > self.preferred[1]) & ~self.preserved
        slack, (low, high) = 0.001, self.preferred
        excused = self.hero | ((table["condense_reason"].str.strip() != "").to_numpy(bool) & (self.context >= self.least_context))
        ordinary = (self.duration <= self.hero_longest + slack) & ((self.duration <= high + slack) | excused)
        allowed = (self.duration >= low - slack) & np.where(self.preserved, self.duration <= self.short + slack, ordinary)
        self.usable = allowed & (column("verified_kill_count") >= self.verified)
        self.context = np.where(self.anchor, 1.0, self.context)  # a placed anchor keeps its moment whole
        self.plain = column("compatibility")
        self.tails = table["tail"].tolist() if "tail" in table and "head" in table else None
        if self.tails is not None:
            self.heads = {n: np.array([h[n] for h in table["head"]]) for n in (*_NUMBERS, *(s for s, _, _ in _STATES), "confidence")}
        self.floor = self.final[~self.hero].max(initial=0.0) - self.margin
        length = max(0.0, self.music.end - self.music.start)
        self.most = min(self.seconds[1], length) if length else self.seconds[1]

    def compatibility(self, chosen: tuple[int, ...]) -> np.ndarray:
        if self.tails is None:
            return self.plain
        if chosen:
            return _likeness(self.tails[chosen[-1]], self.heads)
        return np.array([_likeness(t, {n: v[k : k + 1] for n, v in self.heads.items()})[0] for k, t in enumerate(self.tails)])  # the first shot: its own end and start

    def grown(self, state: tuple, room: float) -> list[tuple]:
        """A state's expansions, at most half of `room` (each uses up what is left, too), in the order of variants; all of them scored."""
        score, elapsed, chosen, kept = state
        last = list(chosen)
        fits = self.usable & (elapsed + self.duration <= self.seconds[1] + 1e-6) & ~np.isin(self.group, self.group[last])
        fits[last] = False
        if len(chosen) >= 2 and self.long[last[-2:]].all():
            fits &= ~self.long
        at = np.flatnonzero(fits)
        if room != float("inf"):
            at = at[: max(0, -(-int(room) // 2))]
        if not len(at):
            return []
        total = elapsed + self.duration[at]
        share = total / np.maximum(np.maximum(self.seconds[1] if chosen else self.most, total), 1.0)
        hint = self.music.start + elapsed
        targets = np.array([hint, self.music.target(hint, False, self.tolerance), self.music.target(hint, True, self.tolerance)])
        which = np.where(self.anchor[at], np.where(self.strong[at], 2, 1), 0)
        target = targets[which]
        curve = np.array(ENERGY_CURVE)
        fit = np.clip(1.0 - np.abs(self.music.energy_at(targets)[which] - np.interp(share, curve[:, 0], curve[:, 1])), 0.0, 1.0)
        again = np.isin(self.source[at], self.source[last[-self.recent[0] :]]) * 0.5 + np.isin(self.environment[at], self.environment[last[-self.recent[1] :]]) * 0.5
        like = self.compatibility(chosen)[at]
        off = np.minimum(1.0, np.abs(np.round(target - hint, 6)) / 2 + np.abs(target - hint) / 2)
        w = self.weights
        gain = w["highlight_quality"] * np.clip(self.final[at], 0, 1) + (w["music_fit"] + w["energy_curve_fit"]) * fit + w["transition_compatibility"] * like + w["diversity"] * np.clip(1.0 - again, 0, 1)
        gain = gain - 0.10 * (1.0 - self.context[at]) - 0.08 * self.penalty[at] - 0.04 * off + np.where((share >= 0.85) & self.hero[at] & (self.final[at] >= self.floor), 0.12, 0.0)
        return [(score + g, t, (*chosen, i), (*kept, (m, l))) for g, t, i, m, l in zip(gain.tolist(), total.tolist(), at.tolist(), target.tolist(), like.tolist())]

    def lanes(self, own: list[tuple]) -> list[tuple]:
        """The best expansions of a state; the last lane goes to a comparable hero where none has one."""
        best = sorted(own, key=lambda s: (-s[0], -self.final[s[2][-1]], self.by_id[s[2][-1]]))[: self.width]
        closing = [s[2][-1] for s in own]
        ordinary = max((self.final[i] for i in closing if not self.hero[i]), default=0.0)
        heroes = [s for s, i in zip(own, closing) if self.hero[i] and min(1.0, max(0.0, self.final[i])) >= ordinary - self.margin]
        if heroes and not any(self.hero[s[2][-1]] for s in best):
            best[-1] = max(heroes, key=lambda s: s[0])
        return best

    def complete(self, states: list[tuple]) -> list[tuple]:
        return [s for s in states if len(s[2]) >= self.shots[0] and self.seconds[0] <= s[1] <= self.most]

    def best(self) -> tuple | None:
        beam, done, left = [(0.0, 0.0, (), ())], [], float("inf") if self.expansions is None else self.expansions
        for _ in range(max(1, self.shots[1])):
            following: list[tuple] = []
            for state in beam:
                done += self.complete([state])
                if len(state[2]) < self.shots[1] and state[1] < self.most - 1e-6:
                    own = self.grown(state, left)
                    left -= len(own)
                    following += self.lanes(own) if own else []
                    if left <= 0:
                        break
            if not following:
                break
            beam = sorted(following, key=lambda s: (-s[0], -s[1], [self.by_id[i] for i in s[2]]))[: self.width]
        done += self.complete(beam)
        if not done:
            return None
        best = max(done, key=lambda s: (s[0], sum(self.context[list(s[2])]), -abs(s[1] - self.most)))
        closing = lambda s: min(1.0, max(0.0, self.final[s[2][-1]]))
        ordinary = [s for s in done if not self.hero[s[2][-1]]]
        if ordinary:  # a hero that closes about as well as the best ordinary edit is preferred
            mark = closing(max(ordinary, key=lambda s: s[0])) - self.margin
            heroes = [s for s in done if self.hero[s[2][-1]] and closing(s) >= mark]
            best = max(heroes, key=lambda s: (s[0], closing(s)), default=best)
        return best


def beam_edit(df: DataFrame, keys: Sequence[str], width: int = 16, shots: tuple[int, int] = (8, 14), seconds: tuple[float, float] = (45.0, 60.0), expansions: int | None = 8192, recent: tuple[int, int] = (2, 2), preferred: tuple[float, float] = (2.0, 10.0), hero_longest: float = 12.0, short: float = 30.0, least_context: float = 0.70, verified: int = 0, hero_margin: float = 0.05, music: Music = Music(), tolerance: float = 0.75, weights: dict[str, float] | None = None) -> DataFrame:
    """(keys, ord, variant_id, timeline_in, timeline_out, section, score, music_target, compatibility): the best edit of a bounded beam search.

    `df` has, per variant: variant_id, duration, final_score, duplicate_group, source, environment (the last three may be
    null: shared with no other), optionally the columns of VARIANT_DEFAULTS, is_hero and preserved (else they follow
    from anchor_type and environment), and head and tail, boundary descriptors of which each pair of neighbours is
    compared (else `compatibility`).

    A state never uses a group or variant twice, passes the time, takes a third long shot in a row, a duration outside the
    policy, or a variant with fewer than `verified` events. An expansion's score weighs quality, the music's energy at the anchor's target,
    the pair's compatibility and variety of the `recent` (sources, environments), less lost context, penalties and the
    anchor's distance from the music. The number of expansions is bounded over the whole search (None: by width, shots and
    variants alone). A project without a complete edit gives no rows."""
    schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys) + ", ord int, variant_id string, timeline_in double, timeline_out double, section string, score double, music_target double, compatibility double"
    names = [*keys, "ord", "variant_id", "timeline_in", "timeline_out", "section", "score", "music_target", "compatibility"]
    rules = {"width": max(1, width), "shots": shots, "seconds": seconds, "expansions": expansions, "recent": (max(1, recent[0]), max(1, recent[1])), "preferred": preferred, "hero_longest": hero_longest, "short": short, "least_context": least_context, "verified": verified, "margin": hero_margin, "music": music, "tolerance": tolerance, "weights": BEAM_WEIGHTS | (weights or {})}

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _Search(pdf, rules)
        best = found.best()
        out, at = [], 0.0
        for n, (i, (target, like)) in enumerate(zip(best[2], best[3]) if best else (), 1):
            share = at / best[1]
            part = "finale" if n == len(best[2]) or share >= 0.85 else "build" if share < 0.20 else "rise" if share < 0.45 else "release" if share < 0.60 else "escalation"
            out.append((*(pdf[k].iloc[0] for k in keys), n, found.ids[i], at, at + found.duration[i], part, best[0], target, like))
            at += found.duration[i]
        return pd.DataFrame(out, columns=names)

    return df.groupBy(*keys).applyInPandas(search, schema)


def violations(df: DataFrame, rules: dict[str, Column], ids: Sequence[str]) -> DataFrame:
    """(ids, rule): a row for each rule that a row breaks; a rule that comes out null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(*ids, F.explode(broken).alias("rule"))


def edit_violations(shots: DataFrame, keys: Sequence[str], low: float, high: float, longest: float = 20.0, slack: float = 1e-3) -> DataFrame:
    """(keys, rule, n) of an edit's shots (ord, timeline_in, timeline_out, duration, duplicate_group, transition): contiguous
    from 0, durations that add up, groups used once, hard cuts, no third long shot in a row, total within bounds."""
    w = Window.partitionBy(*keys).orderBy("ord")
    s = shots.withColumn("_prev", F.coalesce(F.lag("timeline_out").over(w), F.lit(0.0))).withColumn("_uses", F.count("*").over(Window.partitionBy(*keys, "duplicate_group")))
    s = s.withColumn("_long", F.sum((F.col("duration") > longest).cast("int")).over(w.rowsBetween(-2, 0)))
    rules = {
        "contiguous": F.abs(F.col("timeline_in") - F.col("_prev")) <= slack,
        "duration": F.abs(F.col("timeline_out") - F.col("timeline_in") - F.col("duration")) <= slack,
        "unique_group": F.col("_uses") == 1,
        "hard_cut": F.col("transition") == "hard_cut",
        "long_run": F.col("_long") < 3,
    }
    rows = violations(s, rules, [*keys, "ord"]).groupBy(*keys, "rule").agg(F.count("*").alias("n"))
    total = shots.groupBy(*keys).agg(F.max("timeline_out").alias("t")).filter((F.col("t") < low - slack) | (F.col("t") > high + slack))
    return rows.unionByName(total.select(*keys, F.lit("total").alias("rule"), F.lit(1).cast("long").alias("n")))


def detection_violations(events: DataFrame, ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """(event_id, rule): ids used twice, unknown sources or rules, times that are not finite or outside the recording."""
    uses = F.count("*").over(Window.partitionBy("event_id"))
    e = events.withColumn("_uses", uses).join(ledger.select("source_id", F.col("duration").alias("_d")), "source_id", "left").join(rules.select("rule_id", F.lit(True).alias("_known")), "rule_id", "left")
    t = F.col("t")
    return violations(
        e,
        {
            "unique_id": F.col("_uses") == 1,
            "known_source": F.col("_d").isNotNull(),
            "known_rule": F.col("_known"),
            "finite": t.isNotNull() & ~F.isnan(t) & (F.abs(t) != float("inf")),
            "in_range": F.col("_d").isNull() | t.between(0, F.col("_d")),
            "confidence": F.col("confidence").between(0, 1),
        },
        ["event_id"],
    )


def suppress_hits(df: DataFrame, keys: Sequence[str], score: str, id_col: str, overlap: float = 0.25, near: float = 0.7) -> DataFrame:
    """Greedy suppression of boxes (x1, y1, x2, y2) by falling score: one that overlaps a kept box by `overlap` or whose centre
    lies within `near` of the larger side goes."""

    def step(state, row):
        kept = state or []
        x1, y1, x2, y2 = row
        for a1, b1, a2, b2 in kept:
            w, h = max(0.0, min(x2, a2) - max(x1, a1)), max(0.0, min(y2, b2) - max(y1, b1))
            union = (x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - w * h
            side = max(x2 - x1, y2 - y1, a2 - a1, b2 - b1)
            apart = (((x1 + x2 - a1 - a2) / 2) ** 2 + ((y1 + y2 - b1 - b2) / 2) ** 2) ** 0.5
            if (union > 0 and w * h / union >= overlap) or apart <= near * side:
                return kept, 0
        return [*kept, row], 1

    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(id_col))))
    return sorted_scan(ranked, keys, ["_rank"], ["x1", "y1", "x2", "y2"], step, "_kept").filter("_kept = 1").drop("_rank", "_kept")


def row_groups(df: DataFrame, keys: Sequence[str], y: str, tolerance: float, tie: Sequence[str]) -> DataFrame:
    """Adds row: detections from the top down join the row whose running mean of y is within `tolerance`."""

    def step(state, value):
        mean, n, row = state or (None, 0, -1)
        if mean is None or abs(value - mean) > tolerance:
            return (value, 1, row + 1), row + 1
        return ((mean * n + value) / (n + 1), n + 1, row), row

    return sorted_scan(df, keys, [y, *tie], y, step, "row")


