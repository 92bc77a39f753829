"""Column expressions over signals, evidence, intervals and fingerprints. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Evidence channels and the family each belongs to.
FAMILIES: dict[str, str] = {
    "reward_roi_change": "reward",
    "killfeed_change": "killfeed",
    "crosshair_event": "crosshair",
    "objective_roi_change": "objective",
    "damage_border_change": "danger",
    "motion_peak": "action",
    "luminance_change": "action",
    "visual_novelty": "action",
    "audio_transient": "audio",
    "audio_rms": "audio",
    "audio_impact": "audio",
    "multikill_indicator": "multikill_indicator",
    "vehicle_indicator": "vehicle_indicator",
    "objective_indicator": "objective_indicator",
}
# Labels by rising weight, and those that need corroboration.
LABEL_RANK: dict[str, int] = {
    "visual_transient": 0,
    "impact_event": 1,
    "danger_climax": 2,
    "combat_climax": 3,
    "objective": 4,
    "kill": 5,
    "vehicle_destroy": 6,
    "multikill": 7,
}
SEMANTIC = ("kill", "multikill", "vehicle_destroy", "objective")
# Fixed values: (label, its indicator, channels that may corroborate it), in order of priority.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("multikill", "multikill_indicator", ("killfeed_change", "reward_roi_change", "crosshair_event", "audio_transient")),
    ("vehicle_destroy", "vehicle_indicator", ("reward_roi_change", "audio_impact", "crosshair_event", "killfeed_change")),
    ("objective", "objective_indicator", ("objective_roi_change", "crosshair_event", "audio_transient", "motion_peak")),
    ("kill", "killfeed_change", ("reward_roi_change", "crosshair_event", "audio_transient", "audio_impact", "motion_peak")),
)
HASH_BITS = 56


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: str | Column) -> Column:
    """[0, 1]; null stays null (greatest and least alone would skip it)."""
    c = col(c).cast("double")
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def label_rank(c: str | Column) -> Column:
    pairs = [x for k, v in LABEL_RANK.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(c)), F.lit(-1))


# -- parsing ----------------------------------------------------------------------------


def parse_rate(c: str | Column) -> Column:
    """``n/d`` or a number as a rate of three decimals; anything else, and a zero denominator, is 0."""
    text = col(c)
    top = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double")
    low = F.when(F.instr(text, "/") > 0, F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")).otherwise(F.lit(1.0))
    return F.coalesce(F.round(F.try_divide(top, low), 3), F.lit(0.0))


def optional_int(c: str | Column) -> Column:
    """An integer, or null for null, empty, ``N/A`` and what is no number."""
    text = F.trim(col(c))
    return F.nullif(F.nullif(text, F.lit("")), F.lit("N/A")).try_cast("bigint")


def duration_category(c: str | Column, short: float = 90.0, medium: float = 300.0) -> Column:
    d = col(c)
    return F.when(d <= short, "short_clip").when(d <= medium, "medium_clip").otherwise("long_recording")


def clock(seconds: str | Column) -> Column:
    """``MM:SS.mmm`` of a time, from whole milliseconds."""
    ms = F.round(col(seconds) * 1000).cast("bigint")
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)


def content_id(prefix: str, *parts: str | Column, digits: int = 12) -> Column:
    """A name from the SHA-1 of the parts joined by ``|``. Give times as whole milliseconds: they print alike everywhere."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(F.concat_ws("|", *[col(p).cast("string") for p in parts])), 1, digits))


# -- evidence ---------------------------------------------------------------------------


def evidence_map(channels: Sequence[str] = tuple(FAMILIES)) -> Column:
    """The channels above zero, clamped, as a map."""
    every = F.map_from_arrays(F.array(*map(F.lit, channels)), F.array(*[F.coalesce(clamp(c), F.lit(0.0)) for c in channels]))
    return F.map_filter(every, lambda _, v: v > 0)


#: Evidence as a map column, or as the channels' own columns, which need no look-ups.
Evidence = str | Column | Mapping[str, Column]


def channel(evidence: Evidence, name: str) -> Column:
    if isinstance(evidence, Mapping):
        return evidence[name]
    return F.coalesce(F.try_element_at(col(evidence), F.lit(name)), F.lit(0.0))


def noisy_or(values: str | Column) -> Column:
    """1 - product(1 - v) over an array of clamped values; of an empty one 0."""
    return 1 - F.aggregate(col(values), F.lit(1.0), lambda r, v: r * (1 - clamp(v)))


def family_maxima(evidence: Evidence, families: Mapping[str, str] = FAMILIES) -> Column:
    """The largest channel of each family, as an array (families without evidence give 0)."""
    by: dict[str, list[str]] = {}
    for name, family in families.items():
        by.setdefault(family, []).append(name)
    best = [F.greatest(*[channel(evidence, n) for n in names]) if len(names) > 1 else channel(evidence, names[0]) for names in by.values()]
    return F.array(*best)


def classify(evidence: Evidence, threshold: float = 0.35, weak: float = 0.55) -> Column:
    """struct(type, semantic): the first rule whose indicator is corroborated by another family, else a visual fallback with 0."""
    e = evidence if isinstance(evidence, Mapping) else col(evidence)
    out = None
    for label, indicator, companions in RULES:
        own = clamp(channel(e, indicator))
        best = F.greatest(*[F.when(channel(e, c) >= threshold, clamp(channel(e, c))).otherwise(-1.0) for c in companions])
        score = 1 - (1 - own) * (1 - best)
        test = (own >= threshold) & (best >= 0) & (score >= weak)
        value = F.struct(F.lit(label).alias("type"), score.alias("semantic"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(fallback_type(e).alias("type"), F.lit(0.0).alias("semantic")))


def fallback_type(evidence: Evidence) -> Column:
    c = lambda n: channel(evidence, n)
    visual = F.greatest(*map(c, ("reward_roi_change", "killfeed_change", "objective_roi_change", "luminance_change", "visual_novelty")))
    return (
        F.when((c("damage_border_change") >= 0.5) & (F.greatest(c("motion_peak"), c("audio_transient")) >= 0.35), "danger_climax")
        .when(F.greatest(c("crosshair_event"), c("audio_impact")) >= 0.5, "impact_event")
        .when(visual >= 0.5, "visual_transient")
        .otherwise("combat_climax")
    )


# -- fingerprints -----------------------------------------------------------------------


def dhash(grid: str | Column) -> Column:
    """56 bits of an 8x8 grid: in each row, whether a cell is larger than the one to its right, highest bit first."""
    g = col(grid)
    at = lambda i: F.element_at(g, i.cast("int"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(HASH_BITS - 1)),
        F.lit(0).cast("bigint"),
        lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.when(at(F.floor(b / 7) * 8 + b % 7 + 1) > at(F.floor(b / 7) * 8 + b % 7 + 2), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))),
    )


def hamming_similarity(a: str | Column, b: str | Column) -> Column:
    return 1 - F.bit_count(col(a).bitwiseXOR(col(b))) / F.lit(float(HASH_BITS))


def sequence_similarity(a: str | Column, b: str | Column) -> Column:
    """The best mean similarity of the shorter sequence of hashes at any offset in the longer; 0 if either is empty."""
    a, b = col(a), col(b)
    short = F.when(F.size(a) <= F.size(b), a).otherwise(b)
    long = F.when(F.size(a) <= F.size(b), b).otherwise(a)
    n = F.size(short)
    at = lambda o: F.aggregate(F.zip_with(short, F.slice(long, o + 1, n), hamming_similarity), F.lit(0.0), lambda s, x: s + x) / n
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size(long) - n), at))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), best).otherwise(0.0)


def sample_count(duration: str | Column, interval: float) -> Column:
    """Fingerprints of a segment: one per interval, 1 to 16; none without duration."""
    d = col(duration)
    return F.when(d <= 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(16), F.ceil(d / interval).cast("int"))))


def short_sample_count(duration: str | Column, interval: float = 2.0) -> Column:
    """The older form: 2 to 16."""
    return F.greatest(F.lit(2), F.least(F.lit(16), F.floor(col(duration) / interval).cast("int") + 1))


def complete_fingerprint(hashes: str | Column, expected: str | Column) -> Column:
    h = col(hashes)
    return F.coalesce((F.size(h) == col(expected)) & F.forall(h, lambda x: x.isNotNull() & (x >= 0) & (x < (1 << HASH_BITS))), F.lit(False))


# -- rectangles -------------------------------------------------------------------------


def pixel_rect(rect: str | Column, width: str | Column, height: str | Column, truncate: bool = False) -> Column:
    """A rectangle of shares in pixels: rounded half to even, or truncated."""
    to = (lambda x: F.floor(x).cast("int")) if truncate else (lambda x: F.bround(x).cast("int"))
    r, w, h = col(rect), col(width), col(height)
    return F.struct(to(r["x1"] * w).alias("x1"), to(r["y1"] * h).alias("y1"), to(r["x2"] * w).alias("x2"), to(r["y2"] * h).alias("y2"))


def iou(a: str | Column, b: str | Column) -> Column:
    """Intersection over union of two boxes; 0 for empty ones."""
    a, b = col(a), col(b)
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


# -- editing ----------------------------------------------------------------------------


def transition_compatibility(a: str | Column, b: str | Column) -> Column:
    """Likeness of two boundary descriptors in [0, 1], less where either is uncertain."""
    a, b = col(a), col(b)
    same = lambda n, other: F.when(a[n] == b[n], 1.0).otherwise(other)
    numbers = ("motion_strength", "luminance", "visual_tone", "weapon_motion", "impact_strength")
    apart = sum((F.abs(a[n] - b[n]) for n in numbers), F.lit(0.0))
    score = 0.28 * same("motion_direction", 0.35) + 0.38 * (1 - apart / 5) + 0.12 * same("ads_state", 0.45) + 0.12 * same("environment_signature", 0.55) + 0.10 * same("source_signature", 0.7)
    sure = (a["confidence"] >= 0.5) & (b["confidence"] >= 0.5)
    return F.round(clamp(F.when(sure, score).otherwise(score * 0.65)), 6)


def section(elapsed: str | Column, total: str | Column, final: str | Column | None = None) -> Column:
    """The part of the timeline that a share of it falls into."""
    share = F.when(col(total) <= 0, 0.0).otherwise(col(elapsed) / col(total))
    last = share >= 0.85 if final is None else (col(final) | (share >= 0.85))
    return F.when(last, "finale").when(share < 0.20, "build").when(share < 0.45, "rise").when(share < 0.60, "release").otherwise("escalation")


def context_integrity(start, end, anchor, seg_in, seg_out, fragments: int = 1, clipped_tail: bool = False, minimum_tail: float = 1.0) -> Column:
    """How much of a moment's setup and outcome one segment of a candidate keeps."""
    start, end, anchor, a, b = map(col, (start, end, anchor, seg_in, seg_out))
    whole = (F.abs(a - start) <= 0.001) & (F.abs(b - end) <= 0.001)
    setup, tail = clamp((anchor - a) / 1.5), clamp((b - anchor) / 1.0)
    tail_ok = (tail >= 1) | ((tail >= minimum_tail) if clipped_tail else F.lit(False))
    score = 0.45 + 0.20 * setup + 0.20 * tail + 0.15 * clamp((b - a) / 3.0) - 0.15 * max(0, fragments - 1)
    return (
        F.when((a < start) | (b > end), 0.0)
        .when(anchor.isNull(), F.when(whole, 1.0).otherwise(0.65))
        .when((anchor < a) | (anchor > b), 0.0)
        .when(whole, 1.0)
        .when((setup < 1) | ~tail_ok, 0.0)
        .otherwise(F.round(clamp(score), 6))
    )


def duration_allowed(duration, anchor_type, reason, integrity, preferred: tuple[float, float] = (2.0, 10.0), hero: float = 12.0, least_integrity: float = 0.70, preserved: Column | None = None, short: float = 30.0) -> Column:
    """The preferred bounds; a saved short clip up to `short`; a hero, or a documented exception that keeps its context, up to
    `hero`. A millisecond of slack."""
    d, (low, high) = col(duration), preferred
    documented = (F.trim(F.coalesce(col(reason), F.lit(""))) != "") & (col(integrity) >= least_integrity)
    excused = F.coalesce(col(anchor_type).isin("hero_play", "hero", "finale"), F.lit(False)) | F.coalesce(documented, F.lit(False))
    ordinary = (d <= hero + 0.001) & ((d <= high + 0.001) | excused)
    rest = ordinary if preserved is None else F.when(preserved, d <= short + 0.001).otherwise(ordinary)
    return (d >= low - 0.001) & rest


def audio_overlap(compatibility, impact, j_ms, l_ms, bounds: tuple[int, int] = (100, 250), tail_ms: int = 400) -> Column:
    """struct(mode, ms): direct across impacts and unlike pictures; else a J cut, or an L cut where only one is asked for."""
    low, high = max(100, bounds[0]), min(250, bounds[1], tail_ms)
    j, l = col(j_ms), col(l_ms)
    asked = F.when(j > 0, j).when(l > 0, l).otherwise(low)
    ms = F.least(F.lit(high), F.greatest(F.lit(low), asked)).cast("int")
    direct = F.struct(F.lit("direct").alias("mode"), F.lit(0).alias("ms"))
    cut = F.struct(F.when((j > 0) | (l <= 0), "j_cut").otherwise("l_cut").alias("mode"), ms.alias("ms"))
    return F.when(col(impact) | (col(compatibility) < 0.80) | F.lit(high < low), direct).otherwise(cut)


def anchor_window(start, end, anchor, width: float = 6.0) -> Column:
    """struct(source_in, source_out) of `width` around an anchor inside [start, end], shifted at the borders."""
    s, e, a = map(col, (start, end, anchor))
    lo = F.greatest(s, a - width / 2)
    hi = F.least(e, a + width / 2)
    left = F.when((hi - lo < width) & (lo != s), F.greatest(s, hi - width)).otherwise(lo)
    right = F.when((hi - lo < width) & (lo == s), F.least(e, lo + width)).otherwise(hi)
    return F.struct(F.round(left, 3).alias("source_in"), F.round(right, 3).alias("source_out"))
