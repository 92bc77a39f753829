"""Music: onset strength, onsets, tempo and beats of sound, and the points an edit is cut on.

The estimates are the published ones: spectral flux as onset strength, tempo from its autocorrelation under a log-normal prior, beats by
dynamic programming over strength and even spacing (Ellis, 2007). A track is one row; tracks are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import series

HOP, SIZE = 512, 2048


def spread(x: np.ndarray) -> np.ndarray:
    """Between 0 and 1 by the least and the highest value; all 0 where there is no range."""
    x = np.asarray(x, float)
    return (x - x.min()) / (x.max() - x.min()) if len(x) and x.max() - x.min() > 1e-12 else np.zeros(len(x))


def framed(samples: np.ndarray) -> np.ndarray:
    """Frames of SIZE around every HOP samples, the ends padded with silence."""
    padded = np.pad(np.asarray(samples, float), SIZE // 2)
    return np.lib.stride_tricks.sliding_window_view(padded, SIZE)[::HOP]


def onset_strength(samples: np.ndarray) -> np.ndarray:
    """The mean rise of the log spectrum from frame to frame."""
    spectrum = np.log1p(np.abs(np.fft.rfft(framed(samples) * np.hanning(SIZE), axis=1)))
    return np.maximum(0.0, np.diff(spectrum, axis=0, prepend=spectrum[:1])).mean(axis=1)


def energy(samples: np.ndarray) -> np.ndarray:
    return np.sqrt((framed(samples) ** 2).mean(axis=1))


def onset_frames(strength: np.ndarray, rate: int, above: float = 0.07) -> np.ndarray:
    """Frames that are the highest within 30 ms, stand out over the mean of 100 ms around, and are 30 ms from the last one."""
    x = spread(strength)
    near, wide = max(1, round(0.03 * rate / HOP)), max(1, round(0.1 * rate / HOP))
    view = lambda r, fill: np.lib.stride_tricks.sliding_window_view(np.pad(x, r, constant_values=fill), 2 * r + 1)
    if not len(x):
        return np.zeros(0, np.int64)
    peaks = np.flatnonzero((x >= view(near, -1.0).max(axis=1)) & (x >= view(wide, 0.0).mean(axis=1) + above))
    kept: list[int] = []
    for p in peaks.tolist():
        if not kept or p - kept[-1] > near:
            kept.append(p)
    return np.array(kept, np.int64)


def tempo(strength: np.ndarray, rate: int, centre: float = 120.0) -> float:
    """Beats a minute: the lag at which onset strength is most like itself, lags near `centre` weighing more; 0 for silence."""
    x = np.asarray(strength, float) - np.mean(strength) if len(strength) else np.zeros(0)
    per_minute = 60.0 * rate / HOP
    lags = np.arange(max(1, int(per_minute / 320)), min(len(x) - 1, int(per_minute / 30)) + 1)
    if not len(lags) or not x.any():
        return 0.0
    n = 1 << (2 * len(x) - 1).bit_length()
    alike = np.fft.irfft(np.abs(np.fft.rfft(x, n)) ** 2, n)[lags]
    weight = np.exp(-0.5 * np.log2(per_minute / lags / centre) ** 2)
    return float(per_minute / lags[np.argmax(alike * weight)])


def beat_frames(strength: np.ndarray, rate: int, bpm: float, tight: float = 100.0) -> np.ndarray:
    """The sequence of frames with the most onset strength, less how unevenly they are spaced."""
    if bpm <= 0 or not len(strength):
        return np.zeros(0, np.int64)
    x = np.asarray(strength, float)
    x = x / (x.std() or 1.0)
    period = 60.0 * rate / HOP / bpm
    score, before = x.copy(), np.full(len(x), -1)
    back = np.arange(-int(2 * period), -int(period / 2) + 1)
    back = back[back < 0]
    cost = -tight * np.log(-back / period) ** 2
    for t in range(len(x)):
        at = t + back
        ok = at >= 0
        if ok.any():
            values = score[at[ok]] + cost[ok]
            best = int(values.argmax())
            if values[best] > 0:
                score[t], before[t] = x[t] + values[best], at[ok][best]
    last = max(0, len(x) - int(np.ceil(period)))
    beats = [last + int(score[last:].argmax())]
    while before[beats[-1]] >= 0:
        beats.append(int(before[beats[-1]]))
    return np.array(beats[::-1], np.int64)


def analyse(tracks: DataFrame, keys: list[str], samples: str = "samples", rate: str = "rate") -> DataFrame:
    """(keys, tempo, duration, beats, onsets, energy) of tracks, a row each: times in seconds, and energy as (t, value), 0.68 of loudness and
    0.32 of onset strength, each between 0 and 1. A null or empty track has no tempo, beats, onsets or energy."""
    kinds = dict(tracks.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", tempo double, duration double, beats array<double>, onsets array<double>, energy array<struct<t:double,value:double>>"

    def one(raw, hz: int) -> tuple:
        x = np.asarray([] if raw is None else raw, float)
        if not len(x):
            return 0.0, 0.0, [], [], []
        strength, loud = onset_strength(x), energy(x)
        bpm = tempo(strength, hz)
        seconds = lambda frames: (np.asarray(frames) * HOP / hz).tolist()
        both = spread(0.68 * spread(loud) + 0.32 * spread(strength))
        points = [{"t": t, "value": v} for t, v in zip(seconds(range(len(both))), both.tolist())]
        return bpm, len(x) / hz, seconds(beat_frames(strength, hz, bpm)), seconds(onset_frames(strength, hz)), points

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [one(s, int(r)) for s, r in zip(pdf[samples], pdf[rate])]
            yield pdf[keys].assign(**dict(zip(("tempo", "duration", "beats", "onsets", "energy"), zip(*out) if out else ((),) * 5)))

    return tracks.select(*keys, samples, rate).mapInPandas(run, schema)


def structure(analysed: DataFrame, keys: list[str], width: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(points, regions) of analysed tracks: beats, onsets and changes of section (keys, t, type), and regions of energy."""
    beats = analysed.select(*keys, F.explode("beats").alias("t"))
    onsets = analysed.select(*keys, F.explode("onsets").alias("t"))
    levels = analysed.select(*keys, F.explode("energy").alias("e")).select(*keys, "e.t", "e.value")
    regions = series.energy_regions(levels, keys, "t", "value", width)
    changes = regions.filter("start > 0").select(*keys, F.round("start", 3).alias("t"), F.lit("section_change").alias("type"))
    return series.every_nth(beats, onsets, keys, "t").unionByName(changes), regions
