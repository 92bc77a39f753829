r"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark documents, not words, so words are labelled first: in a toxic document a word is part of
a toxic span if one of its features (the word, or a prefix of 3 to 8 bytes, which finds inflected
forms) is found in toxic documents almost only. Near copies count once there. The field has two states
and learns, from these labels, a weight for each feature and for each pair of neighbouring states.

Forward-backward gives every word's marginal. A document's score is a logistic function of its two
highest marginals and of the sum of all, fitted on the documents' own labels; offsets are those of runs of words whose
marginal is at least one half.

The chain of a document is as long as the document. It is walked in blocks of 64 words, all blocks of a batch
at once: the product of a block's transfer matrices carries messages over it, from block to block of a document, and
a second walk within blocks, from these messages, gives every word's.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _labelled
from ._text import _BYTE, LOWER, Words, _tables, byte_class, chunks, mix, ngrams, tidy

#: From this score on a document counts as toxic.
THRESHOLD = 0.3
#: Words of a block of the chain, and the prefixes (in bytes) that are features beside the word.
BLOCK, PREFIXES = 64, (3, 4, 5, 6, 7, 8)
#: Share of the sample's toxic documents that a feature must occur in to mark words; rarer ones are mostly the copies of one document.
SUPPORT = 0.02
#: Sketches of a document of the sample, and the share of them that near copies agree in (an estimate of their similarity).
SKETCHES, ALIKE = 32, 0.7
_LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_SLOTS = 1 << 20


def word_features(words: Words) -> np.ndarray:
    """Hashes of the features of each word, one row per kind; 0 where a word is too short for a prefix."""
    n = len(words.raw)
    out = np.zeros((1 + len(PREFIXES), len(words.start)), np.uint64)
    if not len(words.start):
        return out
    powers, inverse = _tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[words.raw] * powers, out=total[1:])
    size = words.end - words.start
    out[0] = mix((total[words.end] - total[words.start]) * inverse[words.start] + np.uint64(1))
    for k, width in enumerate(PREFIXES, 1):
        long = np.flatnonzero(size >= width)
        at = words.start[long]
        out[k, long] = mix((total[at + width] - total[at]) * inverse[at] + np.uint64(1 + width))
    return out


@dataclass
class Field:
    """Feature hashes (ascending) with weights, a bias, the log potentials of state pairs, and the score's coefficients."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    pair: np.ndarray
    score: np.ndarray

    def __post_init__(self):
        self.slot = np.full(_SLOTS, -1, np.int32)
        # features that fall into one slot form a short chain
        self.next = np.full(len(self.keys), -1, np.int32)
        for k, h in enumerate(self.keys.tolist()):
            s = h & (_SLOTS - 1)
            self.next[k] = self.slot[s]
            self.slot[s] = k

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash among the features, or -1."""
        at = self.slot[(hashes & np.uint64(_SLOTS - 1)).astype(np.int64)]
        out = np.full(len(hashes), -1, np.int32)
        open_ = np.flatnonzero(at >= 0)
        at = at[open_]
        while len(open_):
            same = self.keys[at] == hashes[open_]
            out[open_[same]] = at[same]
            at, open_ = self.next[at[~same]], open_[~same]
            at, open_ = at[at >= 0], open_[at >= 0]
        return out

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.full(features.shape[1], self.bias)
        for row in features:
            at = self.lookup(row)
            hit = np.flatnonzero(at >= 0)
            out[hit] += self.weights[at[hit]]
        return out


    def read(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words of some texts, the marginal of each, and the texts' scores."""
        words = Words(offsets, raw, _LETTERS, LOWER)
        p = marginals(self.emissions(word_features(words)), words.row, self.pair)
        return words, p, _logistic(summaries(p, words.row) @ self.score)


def messages(emission: np.ndarray, row: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds (state 1 against 0) of every word that come forward, its emission included, and backward; `row` are the documents' first words."""
    size = np.diff(row)
    many = -(-size // BLOCK)
    first = np.cumsum(many) - many
    place = np.arange(row[-1]) - np.repeat(row[:-1], size)
    block, place = np.repeat(first, size) + place // BLOCK, place % BLOCK
    total = int(many.sum())
    grid, valid = np.ones((BLOCK, total)), np.zeros((BLOCK, total), bool)
    grid[place, block] = np.exp(np.clip(emission, -40, 40))
    valid[place, block] = True
    (p00, p01), (p10, p11) = np.exp(pair)
    full = np.flatnonzero(size)
    start = np.zeros(total, bool)
    start[first[full]] = True

    # transfer of a block: odds before it to odds after it are (a x + b) / (c x + d); its transpose carries odds backward
    a, b, c, d = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
    if total > len(full):
        for t in range(BLOCK):
            e, on = grid[t], valid[t]
            step = np.stack([e * (p11 * a + p01 * c), e * (p11 * b + p01 * d), p10 * a + p00 * c, p10 * b + p00 * d])
            a, b, c, d = np.where(on, step / step.max(axis=0), (a, b, c, d))
    into, back = np.zeros(total), np.ones(total)
    for j in range(1, int(many.max(initial=0))):
        at = first[many > j] + j - 1
        x = into[at]
        into[at + 1] = _over_first(grid, at, (p00, p01, p10, p11)) if j == 1 else (a[at] * x + b[at]) / (c[at] * x + d[at])
    for j in range(int(many.max(initial=0)) - 2, -1, -1):
        at = first[many > j + 1] + j
        x = back[at + 1]
        back[at] = (a[at + 1] * x + c[at + 1]) / (b[at + 1] * x + d[at + 1])

    forward, backward = np.empty_like(grid), np.empty_like(grid)
    x = forward[0] = np.where(start, grid[0], grid[0] * (p01 + into * p11) / (p00 + into * p10))
    for t in range(1, BLOCK):
        x = forward[t] = grid[t] * (p01 + x * p11) / (p00 + x * p10)
    x = backward[-1] = back
    for t in range(BLOCK - 2, -1, -1):
        y = x * grid[t + 1]
        x = backward[t] = np.where(valid[t + 1], (p10 + y * p11) / (p00 + y * p01), back)
    return forward[place, block], backward[place, block]


def _over_first(grid: np.ndarray, at: np.ndarray, potentials: tuple[float, float, float, float]) -> np.ndarray:
    """Odds after the first block of documents that go on; a document's first word has no pair before it."""
    p00, p01, p10, p11 = potentials
    x = grid[0, at]
    for t in range(1, BLOCK):
        x = grid[t, at] * (p01 + x * p11) / (p00 + x * p10)
    return x


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def marginals(emission: np.ndarray, row: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The probability of state 1 of every word."""
    if not len(emission):
        return np.zeros(0)
    forward, backward = messages(emission, row, pair)
    odds = forward * backward
    return odds / (1.0 + odds)


def summaries(p: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Per document: 1, the log odds of its highest and second highest marginal, the log of one plus their sum."""
    out = np.tile([1.0, -12.0, -12.0, 0.0], (len(row) - 1, 1))
    size = np.diff(row)
    full = np.flatnonzero(size > 0)
    if len(full):
        begin = row[:-1][full]
        doc = np.repeat(np.arange(len(full)), size[full])
        top = np.maximum.reduceat(p, begin)
        at = np.flatnonzero(p == top[doc])
        rest = p.copy()
        rest[at[np.unique(doc[at], return_index=True)[1]]] = 0.0
        for k, best in ((1, top), (2, np.maximum.reduceat(rest, begin))):
            best = np.clip(best, 6e-6, 1 - 6e-6)
            out[full, k] = np.log(best / (1 - best))
        out[full, 3] = np.log1p(np.add.reduceat(p, begin))
    return out


# -- fitting ----------------------------------------------------------------------------


def _sketch(words: Words, parts: int = SKETCHES) -> np.ndarray:
    """Least hashes of each document's five-word runs; two documents agree in about as many as they are similar."""
    grams, hashes = ngrams(words.hashes(), 5), words.hashes()
    out = np.zeros((len(words.row) - 1, parts), np.uint64)
    for k in range(len(out)):
        lo, hi = words.row[k], words.row[k + 1]
        # fewer words are one run, no words are like nothing else
        own = grams[lo : hi - 4] if hi - lo >= 5 else mix(hashes[lo:hi] + np.arange(1, hi - lo + 1, dtype=np.uint64)).sum(keepdims=True) if hi > lo else np.array([k], np.uint64)
        for p in range(parts):
            out[k, p] = mix(own + np.uint64(p)).min()
    return out


def _first_of_copies(sketch: np.ndarray, alike: float = ALIKE) -> np.ndarray:
    """False for documents with a near copy before them: in one of the sketches they agree, and in a share of `alike` of all."""
    n, parts = sketch.shape
    first = np.ones(n, bool)
    for c in range(parts):
        order = np.lexsort((np.arange(n), sketch[:, (c + 1) % parts], sketch[:, c]))
        value = sketch[order, c]
        edge = np.concatenate([[True], value[1:] != value[:-1]]) if n else np.zeros(0, bool)
        head = order[np.maximum.accumulate(np.where(edge, np.arange(n), 0))]
        for other, own in ((order[:-1][~edge[1:]], order[1:][~edge[1:]]), (head[~edge], order[~edge])):
            same = (sketch[other] == sketch[own]).mean(axis=1) >= alike
            first[np.maximum(other, own)[same & (other != own)]] = False
    return first


def fit(y: np.ndarray, text: pa.Array, counts: dict[int, int] | None = None, epochs: int = 25, rate: float = 0.5, support: float = SUPPORT) -> Field | None:
    """The field of a sample's labels and texts; None unless it has both classes, and words. `counts`: ids of each class in all.
    Every feature of the sample has a weight; `support` says which ones may mark words as toxic."""
    if not (y == 1).any() or not (y == 0).any():
        return None
    sizes, alike = [], []
    for _, _, offsets, raw in chunks(text):
        words = Words(offsets, raw, _LETTERS, LOWER)
        sizes.append(np.diff(words.row))
        alike.append(_sketch(words))
    size, alike = np.concatenate(sizes), np.concatenate(alike)
    row = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
    once = _first_of_copies(alike)

    # documents of each feature by class, near copies once
    names, n1, n0 = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo, hi, offsets, raw in chunks(text):
        words = Words(offsets, raw, _LETTERS, LOWER)
        use = np.flatnonzero(once[lo:hi][words.doc])
        seen, toxic = [names], [np.stack([n1, n0])]
        for f in word_features(words):
            own = use[f[use] != 0]
            own = own[np.lexsort((words.doc[own], f[own]))]
            h, d = f[own], words.doc[own]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            is_toxic = y[lo + d[new]] == 1
            seen.append(h[new])
            toxic.append(np.stack([is_toxic, ~is_toxic]).astype(np.int64))
        every, counts_of = np.concatenate(seen), np.concatenate(toxic, axis=1)
        names, at = np.unique(every, return_inverse=True)
        n1, n0 = (np.bincount(at, weights=c, minlength=len(names)).astype(np.int64) for c in counts_of)
    if not len(names):
        return None
    all1, all0 = max(1, int((y[once] == 1).sum())), max(1, int((y[once] == 0).sum()))
    odds = np.log((n1 + 0.5) / (all1 + 1)) - np.log((n0 + 0.5) / (all0 + 1))
    telling = (n1 >= max(3, support * all1)) & (odds > 3.0) & (n1 / all1 > 20 * n0 / all0)
    keys = names
    field = Field(keys, np.zeros(len(keys)), -3.0, np.zeros((2, 2)), np.zeros(4))
    spans = np.unique(names[telling])
    del names, n1, n0, odds, every, counts_of
    marked = np.zeros(len(doc), bool)
    at = np.empty((1 + len(PREFIXES), len(doc)), np.int32)
    for lo, hi, offsets, raw in chunks(text):
        part = slice(row[lo], row[hi])
        for k, f in enumerate(word_features(Words(offsets, raw, _LETTERS, LOWER))):
            marked[part] |= np.isin(f, spans)
            at[k, part] = field.lookup(f)
    at[at < 0] = len(keys)  # a weight that stays 0
    state = (marked & (y[doc] == 1)).astype(float)

    both = doc[1:] == doc[:-1]  # neighbouring words of one document
    seen = np.array([[((state[:-1] == i) & (state[1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)], float)
    scale = max(1.0, state.sum())  # gradients per labelled word
    weights, square = np.zeros(len(keys) + 1), np.full(len(keys) + 1, 1e-8)
    square_pair, square_bias = np.full((2, 2), 1e-8), 1e-8

    def emissions() -> np.ndarray:
        out = np.full(len(doc), field.bias)
        for k in at:
            out += weights[k]
        return out

    for _ in range(epochs):
        emitted = emissions()
        forward, backward = messages(emitted, row, field.pair)
        odds = forward * backward
        error = (state - odds / (1.0 + odds)) / scale
        step = -1e-4 * weights
        for k in at:
            step += np.bincount(k, weights=error, minlength=len(weights))
        step[-1] = 0.0
        square += step**2
        weights += rate * step / np.sqrt(square)
        grad = error.sum()
        square_bias += grad**2
        field.bias += rate * grad / np.sqrt(square_bias)
        left, right = forward[:-1][both], (np.exp(np.clip(emitted, -40, 40)) * backward)[1:][both]
        (p00, p01), (p10, p11) = np.exp(field.pair)
        norm = p00 + p01 * right + left * (p10 + p11 * right)
        expected = np.array([[(p00 / norm).sum(), (p01 * right / norm).sum()], [(p10 * left / norm).sum(), (p11 * left * right / norm).sum()]])
        grad = (seen - expected) / scale - 1e-4 * field.pair
        square_pair += grad**2
        field.pair = field.pair + rate * grad / np.sqrt(square_pair)
    p = marginals(emissions(), row, field.pair)
    field.weights = weights[:-1]
    # the document's score: classes weighted as in all labelled rows
    own = np.array([(y == 0).sum(), (y == 1).sum()])
    share = np.array([counts.get(0, 1), counts.get(1, 1)]) / own if counts else np.ones(2)
    weight = share[y]
    weight = weight / weight.mean()
    x, beta = summaries(p, row), np.zeros(4)
    ridge = np.diag([1e-6, 1e-2, 1e-2, 1e-2]) * len(y) ** 0.5
    for _ in range(30):
        q = _logistic(x @ beta)
        h = (x * (weight * q * (1 - q) + 1e-9)[:, None]).T @ x + ridge
        move = np.linalg.solve(h, x.T @ (weight * (y - q)) - ridge @ beta)
        beta = beta + np.clip(move, -4, 4)
    field.score = beta
    return field


# -- scoring ----------------------------------------------------------------------------


def score(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: id, held_out, score, predicted, and spans (code points, end exclusive).

    A null or empty text has the score of a text without words; equal texts have equal scores, repeated rows repeated ones;
    texts may be of any length. Without a field (no labels of one class) nothing is known and every score is 0. Other columns are
    not looked at, whatever their names. One pass, no shuffle.
    """
    kind = dict(docs.dtypes)[id_col]
    held = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for batch in batches:
            for first, last, offsets, raw in chunks(batch.column(2)):
                own = [batch.column(k).slice(first, last - first) for k in (0, 1)]
                values, spans = np.zeros(last - first), [[] for _ in range(last - first)]
                if f is not None:
                    words, p, values = f.read(offsets, raw)
                    hot = np.flatnonzero(p >= 0.5)
                    if len(hot):
                        new = np.concatenate([[True], (np.diff(hot) != 1) | (np.diff(words.doc[hot]) != 0)])
                        begin, end = hot[new], hot[np.concatenate([new[1:], [True]])]
                        point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                        for d, a, b in zip(words.doc[begin].tolist(), words.start[begin].tolist(), words.end[end].tolist()):
                            zero = point[offsets[d]]
                            spans[d].append({"start": int(point[a] - zero), "end": int(point[b] - zero)})
                yield pa.RecordBatch.from_arrays([*own, pa.array(values), pa.array((values >= threshold).astype(np.int32)), pa.array(spans, span)], names=[id_col, "held_out", "score", "predicted", "spans"])

    schema = f"{id_col} {kind}, held_out boolean, score double, predicted int, spans array<struct<start:long,end:long>>"
    return docs.select(id_col, _labelled.held_out(id_col).alias("held_out"), text_col).mapInArrow(tidy(run), schema)


def _fitted(docs, labels, id_col, text_col, label_col, rows, most_bytes, support) -> Field | None:
    """The field. The sample, of bounded size, is fitted in one task."""
    chosen, counts = _labelled.sample(docs, labels, label_col, rows, most_bytes, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            order = np.argsort(np.concatenate([b.column(0).to_numpy() for b in got]), kind="stable")  # the same field in every run
            y = np.concatenate([b.column(1).to_numpy() for b in got])[order]
            text = pa.concat_arrays([b.column(2).cast(pa.large_string()) for b in got]).take(pa.array(order))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(y, text, counts, support=support))], pa.binary())], names=["field"])

    made = chosen.select(_labelled.spread("id"), "y", "text").repartition(1).mapInArrow(tidy(run), "field binary").collect()
    return pickle.loads(made[0]["field"]) if made else None


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, rows: int = _labelled.SAMPLE_ROWS, most_bytes: int = _labelled.SAMPLE_BYTES, support: float = SUPPORT) -> DataFrame:
    """Fits the field on a bounded sample (`rows` a class, `most_bytes` of their texts) of the labelled documents outside the
    held-out fold, and scores all, as `score` says."""
    return score(docs, _fitted(docs, labels, id_col, text_col, label_col, rows, most_bytes, support), id_col, text_col, threshold)


def drop(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, rows: int = _labelled.SAMPLE_ROWS, most_bytes: int = _labelled.SAMPLE_BYTES, support: float = SUPPORT) -> DataFrame:
    """The rows of `docs`, all columns, with a score below `threshold`: those that `classify` predicts 0.

    A null or empty text is scored as one without words; equal texts stay or go together, repeated rows each for themselves; a null id
    is no reason to go; an empty table stays empty. Columns of any name pass unchanged. Without a field all rows
    stay. One pass, no shuffle.
    """
    field = _fitted(docs, labels, id_col, text_col, label_col, rows, most_bytes, support)
    if field is None:
        return docs
    held, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, raw in chunks(batch.column(at)):
                clean = held.value.read(offsets, raw)[2] < threshold
                yield batch.slice(first, last - first).filter(pa.array(clean))

    return docs.mapInArrow(tidy(run), docs.schema)
