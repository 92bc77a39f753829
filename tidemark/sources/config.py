"""Settings of a project: read from YAML, checked and clamped once on the driver, passed to operators as arguments."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any


def finite(value: Any, default: float, low: float = -math.inf, high: float = math.inf) -> float:
    """A finite number within [low, high]; the default for anything else that is no number."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return default
    return min(high, max(low, x)) if math.isfinite(x) else default


@dataclass(frozen=True)
class Exclusion:
    source_name: str
    start: float
    end: float
    reason: str = ""


def exclusions(value: Any) -> tuple[Exclusion, ...]:
    """Well-formed exclusions, in order; what is malformed, not finite, negative or empty goes."""
    out = []
    for item in value if isinstance(value, (list, tuple)) else ():
        if not isinstance(item, Mapping) or not str(item.get("source_name", "")).strip():
            continue
        a, b = finite(item.get("start"), math.nan), finite(item.get("end"), math.nan)
        if math.isnan(a) or math.isnan(b) or a < 0 or b <= a:
            continue
        out.append(Exclusion(str(item["source_name"]).strip(), a, b, str(item.get("reason", ""))))
    return tuple(out)


#: Bounds that values are clamped to.
BOUNDS: dict[str, tuple[float, float]] = {
    "v2_short_clip_max_duration": (1.0, math.inf),
    "v2_short_clip_prior": (0.0, 1.0),
    "v5_min_kill_semantic_confidence": (0.0, 1.0),
    "v5_min_killfeed_evidence": (0.0, 1.0),
    "v5_min_reward_evidence": (0.0, 1.0),
    "v5_min_verified_kills_per_shot": (0, 100),
    "v5_kill_density_window_s": (0.25, 60.0),
    "v5_kill_density_target": (1, 100),
    "v5_kill_count_weight": (0.0, 1.0),
    "v5_kill_density_weight": (0.0, 1.0),
    "v5_max_sequences_per_candidate": (1, 100),
    "v5_sequence_context_s": (0.1, 10.0),
    "v5_min_rapid_context_tail_s": (0.0, 5.0),
    "v6_coarse_fps": (1.0, 30.0),
    "v6_dense_fps": (1.0, 120.0),
    "v6_panel_disappear_s": (0.1, 5.0),
    "v6_refinement_radius_s": (0.1, 5.0),
    "template_scan_fps": (1.0, 30.0),
    "template_decode_height": (240, 2160),
}
CHOICES: dict[str, tuple[str, ...]] = {"v5_profile": ("off", "quality"), "v2_music_window_policy": ("baseline", "representative")}


@dataclass(frozen=True)
class Settings:
    raw_dir: str = ""
    work_dir: str = ""
    output_dir: str = ""
    music_file: str = ""
    video_extensions: tuple[str, ...] = (".mp4", ".mkv", ".mov", ".webm")
    proxy_resolution: tuple[int, ...] = (960, 540)
    short_clip_threshold: float = 90.0
    long_clip_threshold: float = 300.0
    pre_roll: float = 4.0
    post_roll: float = 6.0
    analysis_fps: float = 2.0
    analysis_sample_rate: int = 22050
    highlight_min_duration: float = 3.0
    highlight_max_duration: float = 30.0
    activity_threshold_percentile: float = 75.0
    activity_merge_gap: float = 3.0
    fingerprint_interval: float = 2.0
    dedupe_threshold: float = 0.78
    output_width: int = 1920
    output_height: int = 1200
    target_fps: float = 60.0
    preview_min_duration: float = 45.0
    preview_max_duration: float = 60.0
    preview_preferred_shot_max_duration: float = 20.0
    baseline_music_in: float = 19.0
    baseline_music_out: float = 74.252
    v2_output_name: str = "preview_60s_v2.mp4"
    payoff_analysis_fps: float = 6.0
    payoff_detector_version: str = "payoff-v2"
    payoff_evidence_threshold: float = 0.35
    event_merge_window_ms: int = 700
    strong_anchor_threshold: float = 0.75
    weak_anchor_threshold: float = 0.55
    max_anchor_count_per_candidate: int = 3
    preferred_macro_duration: tuple[float, ...] = (2.0, 10.0)
    hero_max_duration: float = 12.0
    beam_width: int = 16
    beam_max_expansions: int = 8192
    recent_source_window: int = 2
    recent_environment_window: int = 2
    baseline_music_max_shift: float = 0.5
    audio_overlap_ms: tuple[int, ...] = (100, 250)
    impact_tail_max_ms: int = 400
    minimum_context_integrity: float = 0.70
    rapid_multikill_window_s: float = 4.0
    rapid_multikill_min_events: int = 2
    rapid_multikill_bonus_weight: float = 0.12
    hero_quality_margin: float = 0.05
    boundary_window_ms: int = 500
    anchor_sync_tolerance: float = 0.75
    v2_min_shots: int = 8
    v2_max_shots: int = 14
    v2_short_clip_max_duration: float = 30.0
    v2_short_clip_prior: float = 0.85
    v2_music_window_policy: str = "baseline"
    v5_profile: str = "off"
    v5_min_kill_semantic_confidence: float = 0.80
    v5_min_killfeed_evidence: float = 0.25
    v5_min_reward_evidence: float = 0.10
    v5_min_verified_kills_per_shot: int = 0
    v5_kill_density_window_s: float = 6.0
    v5_kill_density_target: int = 4
    v5_kill_count_weight: float = 0.0
    v5_kill_density_weight: float = 0.0
    v5_max_sequences_per_candidate: int = 1
    v5_sequence_context_s: float = 1.25
    v5_min_rapid_context_tail_s: float = 0.25
    v6_profile_id: str = ""
    v6_detector_version: str = "v6-skull-row-5-calibrated-y-gate"
    v6_coarse_fps: float = 12.0
    v6_dense_fps: float = 60.0
    v6_panel_disappear_s: float = 0.75
    v6_refinement_radius_s: float = 1.0
    v6_initial_search_roi: tuple[float, ...] = (0.25, 0.42, 0.66, 0.75)
    template_scan_fps: float = 30.0
    template_decode_height: int = 720
    template_cache_enabled: bool = True
    full_highlight_target: float = 230.0
    weights: Mapping[str, float] = field(default_factory=dict)
    v2_weights: Mapping[str, float] = field(default_factory=dict)
    beam_weights: Mapping[str, float] = field(default_factory=dict)
    penalty_weights: Mapping[str, float] = field(default_factory=dict)
    roi_profile: Mapping[str, Any] = field(default_factory=dict)
    nvenc: Mapping[str, Any] = field(default_factory=dict)
    audio_mix: Mapping[str, Any] = field(default_factory=dict)
    v2_excluded_ranges: tuple[Exclusion, ...] = ()


def settings(raw: Mapping[str, Any]) -> Settings:
    """Settings from a mapping: unknown keys are ignored, values of the wrong kind fall back to the default, the rest is clamped."""
    made: dict[str, Any] = {}
    for f in fields(Settings):
        if f.name not in raw:
            continue
        value, default = raw[f.name], getattr(Settings(), f.name)
        if f.name == "v2_excluded_ranges":
            made[f.name] = exclusions(value)
        elif f.name in CHOICES:
            text = str(value).strip().lower()
            made[f.name] = text if text in CHOICES[f.name] else default
        elif isinstance(default, bool):
            made[f.name] = bool(value)
        elif isinstance(default, (int, float)):
            x = finite(value, default, *BOUNDS.get(f.name, (-math.inf, math.inf)))
            made[f.name] = int(x) if isinstance(default, int) else float(x)
        elif isinstance(default, tuple):
            kind = type(default[0])
            items = value if isinstance(value, (list, tuple)) else ()
            made[f.name] = tuple(kind(x) for x in items) if items else default
        elif isinstance(default, Mapping):
            made[f.name] = dict(value) if isinstance(value, Mapping) else default
        else:
            made[f.name] = value if value is not None else default
    made["video_extensions"] = tuple(x.lower() for x in made.get("video_extensions", Settings.video_extensions))
    return Settings(**made)


def load(path: str) -> Settings:
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    if not isinstance(raw, Mapping):
        raise ValueError("the settings file holds no mapping")
    return settings(raw)


def long_profile(s: Settings) -> Settings:
    """45 to 90 seconds of 3 to 8 shots."""
    return replace(s, preview_min_duration=45.0, preview_max_duration=90.0, v2_output_name="preview_quality_v4.mp4", v2_min_shots=3, v2_max_shots=8, beam_max_expansions=max(s.beam_max_expansions, 32768), v2_music_window_policy="representative")


def quality_profile(s: Settings) -> Settings:
    """120 to 150 seconds of 10 to 24 shots, each with a verified event."""
    return replace(
        s, preview_min_duration=120.0, preview_max_duration=150.0, v2_output_name="preview_quality_v5.mp4", v2_min_shots=10, v2_max_shots=24, beam_max_expansions=max(s.beam_max_expansions, 65536),
        v2_music_window_policy="representative", v5_profile="quality", v5_min_verified_kills_per_shot=1, v5_kill_count_weight=0.20, v5_kill_density_weight=0.35, v5_max_sequences_per_candidate=6,
    )
