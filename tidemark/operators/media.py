"""Frames, audio and text bytes: statistics that need NumPy, over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byte_entropy(df: DataFrame, ids: list[str], data: str) -> DataFrame:
    """(ids, entropy): Shannon entropy of the bytes of a binary column over 8; 0 for none."""
    schema = ", ".join(f"{i} {dict(df.dtypes)[i]}" for i in ids) + ", entropy double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for raw in pdf[data]:
                counts = np.bincount(np.frombuffer(raw or b"", np.uint8), minlength=256)
                p = counts[counts > 0] / max(1, counts.sum())
                out.append(float(-(p * np.log2(p)).sum() / 8.0) if len(p) else 0.0)
            yield pdf[ids].assign(entropy=out)

    return df.select(*ids, data).mapInPandas(run, schema)


def frame_statistics(frames: DataFrame, keys: list[str], order: list[str], pixels: str = "pixels") -> DataFrame:
    """Adds brightness, black_ratio, entropy and difference (to the frame before, 0 for the first) to rows of grey frames.
    The frame before comes by a window; the arithmetic runs on Arrow batches."""
    from pyspark.sql import Window

    before = F.lag(pixels).over(Window.partitionBy(*keys).orderBy(*order))
    kept = [c for c in frames.columns if c != pixels]
    rows = frames.withColumn("_before", before).select(*kept, pixels, "_before")
    kinds = dict(frames.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", brightness double, black_ratio double, entropy double, difference double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for now, last in zip(pdf[pixels], pdf["_before"]):
                a = np.frombuffer(now, np.uint8)
                counts = np.bincount(a, minlength=256)
                p = counts[counts > 0] / max(1, a.size)
                diff = 0.0 if last is None else float(np.abs(a.astype(np.int16) - np.frombuffer(last, np.uint8)).mean()) / 255.0
                out.append((float(a.mean()) / 255.0, float((a < 8).mean()), float(-(p * np.log2(p)).sum() / 8.0), diff))
            yield pdf[kept].assign(**dict(zip(("brightness", "black_ratio", "entropy", "difference"), zip(*out) if out else ((),) * 4)))

    return rows.mapInPandas(run, schema)


def waveform_features(chunks: DataFrame, keys: list[str], samples: str, rate: int, frame_s: float = 0.05) -> DataFrame:
    """(keys, t, rms, peak, flux) of audio chunks (start_s, samples): Hann frames with half overlap; flux is the rise of the
    spectrum over the frame before it in the chunk. Chunks are independent: give them as long as the memory of a task allows."""
    kinds = dict(chunks.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", t double, rms double, peak double, flux double"
    size = max(2, round(rate * frame_s))
    hop = max(1, size // 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window = np.hanning(size)
        for pdf in batches:
            parts = []
            for i, raw in enumerate(pdf[samples]):
                x = np.asarray(raw, float)
                n = 1 + (len(x) - size) // hop if len(x) >= size else 0
                if not n:
                    continue
                f = np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:n]
                spectrum = np.abs(np.fft.rfft(f * window, axis=1))
                rise = np.maximum(0.0, np.diff(spectrum, axis=0, prepend=spectrum[:1])).mean(axis=1)
                rows = pd.DataFrame({"t": pdf["start_s"].iloc[i] + np.arange(n) * hop / rate, "rms": np.sqrt((f**2).mean(axis=1)), "peak": np.abs(f).max(axis=1), "flux": rise})
                for k in keys:
                    rows[k] = pdf[k].iloc[i]
                parts.append(rows[[*keys, "t", "rms", "peak", "flux"]])
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return chunks.select(*keys, "start_s", samples).mapInPandas(run, schema)


def block_means(pixels: np.ndarray, side: int = 32, cells: int = 8) -> np.ndarray:
    """The means of a square frame's cells, row by row: the grid of a perceptual hash."""
    step = side // cells
    return np.asarray(pixels, float).reshape(cells, step, cells, step).mean(axis=(1, 3)).ravel()


def template_score(frame: np.ndarray, template: np.ndarray) -> float:
    """The highest normalised cross-correlation of a template with any place of a frame; 0 for constant input."""
    f, t = np.asarray(frame, float), np.asarray(template, float)
    if t.shape[0] > f.shape[0] or t.shape[1] > f.shape[1] or t.std() <= 1e-6:
        return 0.0
    views = np.lib.stride_tricks.sliding_window_view(f, t.shape)
    centred = t - t.mean()
    means = views.mean(axis=(2, 3), keepdims=True)
    spread = np.sqrt(((views - means) ** 2).sum(axis=(2, 3))) * np.sqrt((centred**2).sum())
    score = np.divide(((views - means) * centred).sum(axis=(2, 3)), spread, out=np.zeros(spread.shape), where=spread > 1e-9)
    return float(score.max())


def usable_image(pixels: str | Column, width: str, height: str) -> Column:
    """At least 2x2 and not constant."""
    p = F.col(pixels) if isinstance(pixels, str) else pixels
    return (F.col(width) >= 2) & (F.col(height) >= 2) & (F.size(F.array_distinct(p)) > 1)


def orange_ratio(rgb: np.ndarray) -> float:
    """Share of pixels with a hue of at most 36 or at least 340 degrees, and saturation and value of at least 80 of 255."""
    if not np.asarray(rgb).size:
        return 0.0
    hue, saturation, top = hsv(np.asarray(rgb).reshape(-1, 3))
    return float((((hue <= 18) | (hue >= 170)) & (saturation >= 80) & (top >= 80)).mean())


def region(frame: np.ndarray, bounds: tuple[float, float, float, float]) -> np.ndarray:
    """A region given in shares of the frame, at least a pixel wide and high."""
    height, width = frame.shape[:2]
    x = sorted(int(round(min(1.0, max(0.0, v)) * width)) for v in (bounds[0], bounds[2]))
    y = sorted(int(round(min(1.0, max(0.0, v)) * height)) for v in (bounds[1], bounds[3]))
    return frame[y[0] : max(y[1], y[0] + 1), x[0] : max(x[1], x[0] + 1)]


def region_change(before: np.ndarray | None, now: np.ndarray) -> float:
    """Three times the mean absolute difference over 255, clamped; 0 without a frame before of the same shape."""
    if before is None or before.shape != now.shape or not now.size:
        return 0.0
    return float(min(1.0, np.abs(now.astype(np.int16) - before.astype(np.int16)).mean() / 255.0 * 3.0))


def border_red_change(before: np.ndarray | None, now: np.ndarray, width: int = 2) -> float:
    """Four times the change of the mean excess of red in the border, clamped."""
    if before is None or before.shape != now.shape or not now.size:
        return 0.0

    def excess(f: np.ndarray) -> float:
        edge = np.concatenate([x.reshape(-1, 3) for x in (f[:width], f[-width:], f[:, :width], f[:, -width:])]).astype(float)
        return float(np.maximum(edge[:, 0] - np.maximum(edge[:, 1], edge[:, 2]), 0.0).mean() / 255.0)

    return min(1.0, abs(excess(now) - excess(before)) * 4.0)


def frame_channels(frames: DataFrame, keys: list[str], order: list[str], regions: dict[str, tuple[float, float, float, float]], pixels: str = "pixels") -> DataFrame:
    """(keys, order, a change per named region, damage_border_change, orange) of rows of RGB frames (width, height, pixels)."""
    from pyspark.sql import Window

    rows = frames.withColumn("_before", F.lag(pixels).over(Window.partitionBy(*keys).orderBy(*order)))
    kinds, names = dict(frames.dtypes), [*keys, *order]
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + "".join(f", {n} double" for n in regions) + ", damage_border_change double, orange double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list[float]] = {n: [] for n in [*regions, "damage_border_change", "orange"]}
            for raw, last, w, h in zip(pdf[pixels], pdf["_before"], pdf["width"], pdf["height"]):
                now = np.frombuffer(raw, np.uint8).reshape(h, w, 3)
                old = None if last is None or len(last) != len(raw) else np.frombuffer(last, np.uint8).reshape(h, w, 3)
                for n, bounds in regions.items():
                    out[n].append(region_change(None if old is None else region(old, bounds), region(now, bounds)))
                out["damage_border_change"].append(border_red_change(old, now))
                out["orange"].append(orange_ratio(now))
            yield pdf[names].assign(**out)

    return rows.select(*names, "width", "height", pixels, "_before").mapInPandas(run, schema)


def template_hits(frame: np.ndarray, template: np.ndarray, threshold: float, most: int = 32) -> list[tuple[int, int, float]]:
    """(x, y, score) of the places where a template matches best locally, the best first, `most` at most."""
    f, t = np.asarray(frame, float), np.asarray(template, float)
    if t.shape[0] > f.shape[0] or t.shape[1] > f.shape[1] or t.std() <= 1e-6:
        return []
    views = np.lib.stride_tricks.sliding_window_view(f, t.shape)
    centred, means = t - t.mean(), views.mean(axis=(2, 3), keepdims=True)
    spread = np.sqrt(((views - means) ** 2).sum(axis=(2, 3))) * np.sqrt((centred**2).sum())
    score = np.divide(((views - means) * centred).sum(axis=(2, 3)), spread, out=np.zeros(spread.shape), where=spread > 1e-9)
    padded = np.pad(score, 1, constant_values=-2.0)
    around = np.max([padded[y : y + score.shape[0], x : x + score.shape[1]] for y in range(3) for x in range(3) if (y, x) != (1, 1)], axis=0)
    ys, xs = np.nonzero((score >= threshold) & (score >= around))
    found = sorted(((int(x), int(y), float(score[y, x])) for y, x in zip(ys, xs)), key=lambda h: (-h[2], h[1], h[0]))
    return found[:most]


def resampled(image: np.ndarray, scale: float) -> np.ndarray:
    """An image at another scale, by the nearest pixel."""
    h, w = image.shape[:2]
    rows = np.minimum(h - 1, (np.arange(max(2, round(h * scale))) / scale).astype(int))
    columns = np.minimum(w - 1, (np.arange(max(2, round(w * scale))) / scale).astype(int))
    return image[rows][:, columns]


def best_match(frame: np.ndarray, templates: list[np.ndarray], scales: tuple[float, ...] = (0.8, 0.9, 1.0, 1.1, 1.2)) -> float:
    """The best score of any template at any scale."""
    return max((template_score(frame, resampled(t, s)) for t in templates for s in scales), default=0.0)


def scaled(image: np.ndarray) -> np.ndarray:
    """A grey picture between 0 and 255; all 0 where it is constant."""
    x = np.asarray(image, float)
    low, high = x.min(), x.max()
    return (x - low) / (high - low) * 255.0 if high > low else np.zeros_like(x)


def area_resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A grey picture at another size: every new pixel is the mean of the area it covers."""

    def weights(old: int, new: int) -> np.ndarray:
        edges = np.arange(new + 1) * old / new
        low, high = np.maximum(edges[:-1, None], np.arange(old)), np.minimum(edges[1:, None], np.arange(old) + 1)
        w = np.maximum(0.0, high - low)
        return w / w.sum(axis=1, keepdims=True)

    x = np.asarray(image, float)
    return weights(x.shape[0], height) @ x @ weights(x.shape[1], width).T


def edges(image: np.ndarray, low: float = 50.0, high: float = 120.0) -> np.ndarray:
    """The edges of a grey picture: Sobel gradients (sum of magnitudes), thinned along their direction, those above `high` and all above
    `low` that are connected to them."""
    x = np.pad(np.asarray(image, float), 1, mode="edge")
    rows = lambda a, b, c: a + 2 * b + c
    gx = rows(x[:-2, 2:], x[1:-1, 2:], x[2:, 2:]) - rows(x[:-2, :-2], x[1:-1, :-2], x[2:, :-2])
    gy = rows(x[2:, :-2], x[2:, 1:-1], x[2:, 2:]) - rows(x[:-2, :-2], x[:-2, 1:-1], x[:-2, 2:])
    size = np.abs(gx) + np.abs(gy)
    around = np.pad(size, 1)
    h, w = size.shape
    at = lambda dy, dx: around[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    flat, steep = np.abs(gy) <= 0.4142 * np.abs(gx), np.abs(gy) >= 2.4142 * np.abs(gx)
    falling = np.where(gx * gy < 0, -1, 1)
    before = np.select([flat, steep, falling > 0], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    after = np.select([flat, steep, falling > 0], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    thin = (size > before) & (size >= after)
    weak, found = thin & (size > low), thin & (size > high)
    while True:
        grown = np.pad(found, 1)
        near = np.any([grown[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], axis=0) & weak
        if (near == found).all():
            return found
        found = near


def edge_shape_score(image: np.ndarray, template: np.ndarray) -> float:
    """How well the edges of a picture, at a template's size, agree with the template's: their F1; 0 where either has none."""
    image, template = np.asarray(image, float), np.asarray(template, float)
    if not image.size or not template.size:
        return 0.0
    a, b = edges(scaled(area_resized(image, *template.shape))), edges(scaled(template))
    both = int((a & b).sum())
    return 2.0 * both / (int(a.sum()) + int(b.sum())) if both else 0.0


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue (0 to 180, two degrees each), saturation and value (0 to 255) of an RGB picture."""
    x = np.asarray(rgb, float)
    top, low = x.max(axis=-1), x.min(axis=-1)
    spread = np.where(top - low > 0, top - low, 1.0)
    r, g, b = np.moveaxis(x, -1, 0)
    hue = np.select([top == r, top == g], [(g - b) / spread % 6, (b - r) / spread + 2], (r - g) / spread + 4) * 30.0
    return hue, np.where(top > 0, (top - low) / np.where(top > 0, top, 1.0) * 255.0, 0.0), top


def opened_lines(mask: np.ndarray, length: int) -> np.ndarray:
    """The parts of a mask that lie in horizontal runs of at least `length` pixels."""
    if length > mask.shape[1]:
        return np.zeros_like(mask)
    full = np.lib.stride_tricks.sliding_window_view(mask, length, axis=1).all(axis=2)
    out = np.zeros_like(mask)
    for k in range(length):
        out[:, k : k + full.shape[1]] |= full
    return out


def panel_structure(rgb: np.ndarray, row: tuple[int, int, int, int]) -> float:
    """How much the surroundings of a row (x1, y1, x2, y2) look like a card: saturated red names, and white outlines of long straight lines.

    Fixed values: the margins, hue, saturation and value bounds, the densities of a full score and the weights of both parts."""
    x1, y1, x2, y2 = row
    width, height = max(1, x2 - x1), max(1, y2 - y1)
    side = max(45, int(width * 2.5))
    around = rgb[max(0, y1 - max(2, int(height * 0.25))) : min(rgb.shape[0], y2 + max(72, int(height * 2.2))), max(0, x1 - side) : min(rgb.shape[1], x2 + side)]
    if not around.size:
        return 0.0
    hue, saturation, value = hsv(around)
    names = ((hue <= 12) | (hue >= 168)) & (saturation >= 100) & (value >= 80)
    grey = np.asarray(around, float) @ np.array([0.299, 0.587, 0.114])
    white = (grey >= 135) & (saturation < 115)
    lines = opened_lines(white, max(5, int(width * 0.16))) | opened_lines(white.T, max(3, int(height * 0.10))).T
    return float(min(1.0, 0.72 * min(1.0, names.mean() / 0.045) + 0.28 * min(1.0, lines.mean() / 0.018)))


def count_states(frames: DataFrame, keys: list[str], templates: list[np.ndarray], threshold: float = 0.62, shape: float = 0.25, structure: float = 0.0, row_tolerance: float = 6.0, scales: tuple[float, ...] = (0.9, 1.0, 1.1)) -> DataFrame:
    """(keys, t, present, count, confidence) of RGB frames (t, width, height, pixels): icons are places where a template matches by
    correlation and by the shape of its edges; of those that overlap the better stays; the row with the most of them counts
    if its surroundings have at least the given structure."""
    kinds = dict(frames.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", t double, present boolean, count long, confidence double"

    def icons(grey: np.ndarray) -> list[tuple[float, int, int, int, int]]:
        found = []
        for template in templates:
            for scale in scales:
                t = resampled(template, scale)
                h, w = t.shape
                for x, y, score in template_hits(grey, t, threshold):
                    if edge_shape_score(grey[y : y + h, x : x + w], template) >= shape:
                        found.append((score, x, y, w, h))
        kept: list[tuple[float, int, int, int, int]] = []
        for hit in sorted(found, key=lambda f: (-f[0], f[2], f[1])):
            _, x, y, w, h = hit
            if all(((x + w / 2 - a - c / 2) ** 2 + (y + h / 2 - b - d / 2) ** 2) ** 0.5 > 0.7 * max(w, h, c, d) for _, a, b, c, d in kept):
                kept.append(hit)
        return kept

    def state(rgb: np.ndarray) -> tuple[bool, int, float]:
        rows: list[list[tuple[float, int, int, int, int]]] = []
        for hit in sorted(icons(np.rint(rgb.astype(float) @ np.array([0.299, 0.587, 0.114]))), key=lambda f: f[2] + f[4] / 2):
            middle = hit[2] + hit[4] / 2
            if rows and abs(np.mean([r[2] + r[4] / 2 for r in rows[-1]]) - middle) <= row_tolerance:
                rows[-1].append(hit)
            else:
                rows.append([hit])
        if not rows:
            return False, 0, 0.0
        best = max(rows, key=lambda r: (len(r), sum(h[0] for h in r)))
        bounds = (min(h[1] for h in best), min(h[2] for h in best), max(h[1] + h[3] for h in best), max(h[2] + h[4] for h in best))
        if structure > 0 and panel_structure(rgb, bounds) < structure:
            return False, 0, 0.0
        return True, len(best), float(np.mean([h[0] for h in best]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [state(np.frombuffer(p, np.uint8).reshape(h, w, 3)) for p, w, h in zip(pdf["pixels"], pdf["width"], pdf["height"])]
            yield pdf[[*keys, "t"]].assign(**dict(zip(("present", "count", "confidence"), zip(*out) if out else ((),) * 3)))

    return frames.select(*keys, "t", "width", "height", "pixels").mapInPandas(run, schema)


def template_scores(frames: DataFrame, keys: list[str], templates: list[np.ndarray], bounds: tuple[float, float, float, float], scales: tuple[float, ...] = (0.8, 0.9, 1.0, 1.1, 1.2)) -> DataFrame:
    """(keys, t, score) of RGB frames: the best match of any template at any scale in a region given in shares of the frame."""
    kinds = dict(frames.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            grey = (np.frombuffer(p, np.uint8).reshape(h, w, 3) @ np.array([0.299, 0.587, 0.114]) for p, w, h in zip(pdf["pixels"], pdf["width"], pdf["height"]))
            yield pdf[[*keys, "t"]].assign(score=[best_match(region(g, bounds), templates, scales) for g in grey])

    return frames.select(*keys, "t", "width", "height", "pixels").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", t double, score double")


def row_geometry(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, n, y_score, size_score, spacing_score) of detections grouped into rows (row, x, y, size): how level, alike and
    evenly spaced they are."""
    from pyspark.sql import Window

    gap = F.col("x") - F.lag("x").over(Window.partitionBy(*keys, "row").orderBy("x"))
    even = lambda c: F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(F.stddev_pop(c), F.avg(c)), F.lit(0.0)))
    level = F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(F.stddev_pop("y"), F.avg("size")), F.lit(0.0)))
    return df.withColumn("_gap", gap).groupBy(*keys, "row").agg(F.count("*").alias("n"), level.alias("y_score"), even("size").alias("size_score"), even("_gap").alias("spacing_score"))


def waveform_density(df: DataFrame, keys: list[str], flux: str = "flux", share: float = 0.75) -> DataFrame:
    """Adds active: whether a frame's flux is at least the given percentile of its key."""
    level = df.groupBy(*keys).agg(F.percentile(flux, share).alias("_level"))
    return df.join(level, keys).withColumn("active", F.col(flux) >= F.col("_level")).drop("_level")
