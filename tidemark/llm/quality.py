r"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows of good quality; everything else is unlabelled web text, whose share
of positives (the class prior) is estimated, not known. The model is additive: each measure of a text's
form is cut into quantile bins with a weight each. With the logistic loss l, positives P,
unlabelled U and prior p, it minimises

    p E_P l(+) + max(0, E_U l(-) - p E_P l(-))

and steps back where the second term has fallen below zero, which keeps a flexible model from taking
unlabelled positives for negatives.

The measures of every document are taken once and written. The borders of the bins and the prior are statistics of all documents
outside the held-out fold; only the descent itself sees bounded samples of the two sides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _labelled
from ._tables import written
from ._text import LOWER, NOT_SPACE, Words, byte_class, chunks, ngrams, tidy

#: From this score on a document counts as good.
THRESHOLD = 0.7
#: Quantile bins of each measure.
BINS = 16
_CLASSES = {
    "upper": byte_class((0x41, 0x5A)),
    "digit": byte_class((0x30, 0x39)),
    "stop": byte_class((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F)),
    "comma": byte_class((0x2C, 0x2C)),
    "pipe": byte_class((0x7C, 0x7C)),
    "sign": byte_class((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),
    "other": byte_class((0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x7F)),
}
_NOT_LINE = ~byte_class((0x0A, 0x0A), (0x0D, 0x0D))
#: Cells of the histogram that the bins' borders are read from, for each measure.
CELLS = 2048
#: Partial histograms that reach the driver, at most.
_PARTS = 32
MEASURES = ("words", "length", *_CLASSES, "new words", "new lines", "new triples", "echo")


def _distinct(values: np.ndarray, doc: np.ndarray, many: int) -> np.ndarray:
    """Number of distinct values in each document."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=many)


def measures(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The measures of each text, a row each; of an empty text all are those of no words."""
    many = len(offsets) - 1
    words = Words(offsets, raw, NOT_SPACE, LOWER)
    h, n = words.hashes(), np.diff(words.row)
    size = np.maximum(1, np.diff(offsets))
    out = [np.log1p(n), np.bincount(words.doc, weights=words.end - words.start, minlength=many) / np.maximum(1, n)]
    for table in _CLASSES.values():
        total = np.concatenate([[0], np.cumsum(table[raw])])
        out.append(np.diff(total[offsets]) / size)
    out.append(_distinct(h, words.doc, many) / np.maximum(1, n))
    lines = Words(offsets, raw, _NOT_LINE)
    out.append(_distinct(lines.hashes(), lines.doc, many) / np.maximum(1, np.diff(lines.row)))
    triples = ngrams(h, 3)
    inside = words.doc[: len(triples)] == words.doc[2:] if len(triples) else np.zeros(0, bool)
    of = words.doc[: len(triples)][inside]
    out.append(_distinct(triples[inside], of, many) / np.maximum(1, np.bincount(of, minlength=many)))
    again = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1]) if len(h) else np.zeros(0, bool)
    out.append(np.bincount(words.doc[1:][again], minlength=many) / np.maximum(1, n))
    return np.stack(out, axis=1)


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Inner borders of the bins of each measure, a weight for each bin, a bias, and the prior it was fitted with."""

    borders: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, x[:, k], side="left") + k * (BINS + 1) for k, b in enumerate(self.borders)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x)].sum(axis=1) + self.bias


def _descend(model: Model, good: np.ndarray, mixed: np.ndarray, gradient, steps: int, rate: float = 0.05) -> None:
    """Adam over the additive model; `gradient` gives the derivative of the risk by each row's logit."""
    width = len(model.weights)
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        a, b = model.weights[good].sum(axis=1) + model.bias, model.weights[mixed].sum(axis=1) + model.bias
        ga, gb = gradient(a, b)
        g = np.zeros(width + 1)
        for bins, d in ((good, ga), (mixed, gb)):
            g[:width] += np.bincount(bins.ravel(), weights=np.repeat(d, bins.shape[1]), minlength=width)
            g[width] += d.sum()
        g[:width] += 1e-4 * model.weights
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        model.weights = model.weights - move[:width]
        model.bias -= move[width]


def thresholds(good: np.ndarray) -> np.ndarray:
    """Scores at which the shares of positives and of unlabelled rows are compared."""
    return np.unique(np.quantile(good, np.linspace(0.0, 0.95, 96)))


def estimate_prior(good: np.ndarray, u: np.ndarray, many: int) -> float:
    """The share of positives among `many` unlabelled rows, from the scores of positives and the shares `u` of unlabelled rows at
    or above each of their thresholds.

    Above any score, the unlabelled share is at least prior times the positives' share. The
    least ratio of the two, with room for the error of both shares, bounds the prior from above and is
    reached where a region holds positives only.
    """
    p = np.array([(good >= t).mean() for t in thresholds(good)])
    room = np.sqrt(np.log(20) / (2 * len(good))) + np.sqrt(np.log(20) / (2 * many))
    best = int(np.argmin((u + room * (1 + u / np.maximum(p, 1e-9))) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def halves(good: np.ndarray, mixed: np.ndarray, half_good: np.ndarray, half_mixed: np.ndarray, borders: list[np.ndarray], steps: int = 300) -> list[Model]:
    """Positives against unlabelled rows, fitted on each half (0 and 1) of both sides: for the prior alone. Each half is scored by the model of the other."""
    out = []
    for half in (0, 1):
        a, b = (x[h == half] if (h == half).any() else x for x, h in ((good, half_good), (mixed, half_mixed)))
        model = Model(borders, np.zeros(good.shape[1] * (BINS + 1)), 0.0, 0.5)
        _descend(model, model.bins(a), model.bins(b), lambda x, y: (-_logistic(-x) / len(x), _logistic(y) / len(y)), steps)
        out.append(model)
    return out


def crossed(models: list[Model], x: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The logit of each row by the model of the other half."""
    return np.where(half == 0, models[1].logits(x), models[0].logits(x))


def fit(good: np.ndarray, mixed: np.ndarray, borders: list[np.ndarray], prior: float, steps: int = 4000) -> Model:
    """The model of the measures of trusted positives and of unlabelled rows, of least non-negative risk."""
    model = Model(borders, np.zeros(good.shape[1] * (BINS + 1)), 0.0, prior)

    def softplus(x):
        return np.logaddexp(0.0, x)

    def risk(a, b):
        negative = softplus(b).mean() - prior * softplus(a).mean()
        if negative >= 0:
            return (-prior * _logistic(-a) - prior * _logistic(a)) / len(a), _logistic(b) / len(b)
        return prior * _logistic(a) / len(a), -_logistic(b) / len(b)  # a step back

    _descend(model, model.bins(good), model.bins(mixed), risk, steps)
    return model


# -- statistics of all documents --------------------------------------------------------


def _edges(k: int) -> np.ndarray:
    """Upper ends of the cells of measure k, ascending from 0: fine near 0 for shares, even for what is mostly near 1, in steps of logarithms for sizes."""
    even = np.arange(CELLS + 1) / CELLS
    return 25 * even if MEASURES[k] == "words" else np.expm1(20 * even) if MEASURES[k] == "length" else even if MEASURES[k].startswith("new") else even**4


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(MEASURES))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held, half, x) of every row: whether it is held out, a half for cross-fitting, and its measures. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, raw in chunks(batch.column(3)):
                x = measures(offsets, raw)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in range(3)), values], names=["id", "held", "half", "x"])

    half = F.pmod(_labelled.spread(id_col), F.lit(2)).cast("int").alias("half")
    columns = docs.select(F.col(id_col).alias("id"), _labelled.held_out(id_col).alias("held"), half, F.col(text_col).alias("t"))
    return columns.mapInArrow(tidy(run), f"id {dict(docs.dtypes)[id_col]}, held boolean, half int, x array<double>")


def borders_of(table: DataFrame) -> list[np.ndarray]:
    """Inner borders of the bins of each measure: quantiles of all rows that are not held out, to the width of a cell."""
    edges = [_edges(k) for k in range(len(MEASURES))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(MEASURES), CELLS + 2), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            for k, e in enumerate(edges):
                total[k] += np.bincount(np.searchsorted(e, x[:, k], side="left"), minlength=CELLS + 2)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["z"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(MEASURES), CELLS + 2), np.int64)
        for batch in batches:
            for z in batch.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(z), np.int64).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["z"])

    parts = table.filter("not held").select("x").mapInArrow(tidy(count), "z binary").repartition(_PARTS).mapInArrow(tidy(add), "z binary").collect()
    total = sum(np.frombuffer(zlib.decompress(r["z"]), np.int64).reshape(len(MEASURES), CELLS + 2) for r in parts)
    out = []
    for k, e in enumerate(edges):
        sums = np.cumsum(total[k])
        at = np.searchsorted(sums, np.linspace(0, 1, BINS + 1)[1:-1] * sums[-1], side="left")
        out.append(np.unique(e[np.minimum(at, CELLS)]))
    return out


def shares_above(table: DataFrame, models: list[Model], tops: np.ndarray) -> tuple[np.ndarray, int]:
    """Of all rows that are not held out the share with a crossed logit of at least each of `tops`, and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tops) + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                logits = crossed(models, _matrix(batch.column(1)), batch.column(0).to_numpy())
                total += np.bincount(np.searchsorted(tops, logits, side="right"), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "n"])

    rows = table.filter("not held").select("half", "x").mapInArrow(tidy(count), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(tops) + 1, np.int64)
    for r in rows:
        total[r["k"]] = r["n"]
    return np.cumsum(total[::-1])[::-1][1:] / max(1, total.sum()), int(total.sum())


def _rows(table: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Measures and halves of a bounded number of ids, in the order of their hashes; of rows that share an id the least."""
    found = table.join(F.broadcast(ids), "id").groupBy("id", "half").agg(F.min("x").alias("x")).orderBy(_labelled.spread("id"), "id").collect()
    return np.array([r["x"] for r in found]).reshape(-1, len(MEASURES)), np.array([r["half"] for r in found], np.int64)


def learn(table: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = _labelled.SAMPLE_ROWS, id_col: str = "doc_id") -> Model | None:
    """The model of a table of measures: fitted on at most `rows` trusted positives and `rows` unlabelled documents, the ones of least
    hash outside the held-out fold, with borders and prior of all documents there. None without positives or documents."""
    ids, _ = _labelled.chosen_ids(labels, label_col, rows, id_col)
    good, half_good = _rows(table, ids.filter("y = 1").select("id"))
    some = table.filter("not held and id is not null").select("id").distinct().orderBy(_labelled.spread("id"), "id").limit(rows)
    mixed, half_mixed = _rows(table, some)
    if not len(good) or not len(mixed):
        return None
    borders = borders_of(table)
    models = halves(good, mixed, half_good, half_mixed, borders)
    scores = crossed(models, good, half_good)
    return fit(good, mixed, borders, estimate_prior(scores, *shares_above(table, models, thresholds(scores))))


def score(table: DataFrame, model: Model | None, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of a table of measures: id, held_out, score, predicted. Without a model every score is one half."""
    held = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            values = np.full(batch.num_rows, 0.5) if m is None else _logistic(m.logits(_matrix(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values), pa.array((values >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    schema = f"{id_col} {dict(table.dtypes)['id']}, held_out boolean, score double, predicted int"
    return table.select("id", "held", "x").mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, rows: int = _labelled.SAMPLE_ROWS) -> DataFrame:
    """One row per row of `docs`: id, held_out, score, predicted; fitted as `learn` says.

    A null or empty text is scored as one without words, a very long one like any other; equal texts have equal scores, repeated rows
    repeated ones. Without a model (no positives, or no documents to learn from, as in an empty table) every score is one half. Other
    columns are not looked at, whatever their names. Texts are read once; their measures (some hundred bytes a row) are written.
    """
    table = written(measured(docs, id_col, text_col))
    return score(table, learn(table, labels, label_col, rows, id_col), id_col, threshold)
