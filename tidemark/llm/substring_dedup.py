r"""Substring deduplication with prefix-partitioned suffix trees.

Every word position with `window` words behind it starts a suffix. A repeat of at least `window`
words between two documents is an inner node, at that depth or deeper, of the suffix tree of all of them. The tree is
built in parts, each of the suffixes that share a prefix:

1. A suffix's first prefix ends with its anchor, the `gram` words of least hash within its first `window`
   words. Its length varies; the anchor follows from these words alone, so equal suffixes share it, and
   neighbouring suffixes of a document mostly do, and travel as one stretch of text. Suffixes and documents are counted
   by anchor (combined before the shuffle): where only one document has an anchor there is no repeat, and its text is never moved.
2. Anchors of more than `group_rows` suffixes are split: each suffix's prefix is lengthened to its first 4, 16,
   ... words until the suffixes that share it fit. At `window` words all that share it are one node.
3. A task builds the tree of each group from its words: suffixes in order (a suffix array), the words
   that neighbours have in common, and the inner nodes of depth `window`. A suffix
   below a node with a smaller document is repeated; consecutive ones are the maximal repeats.

Equal suffixes of one batch of documents are settled before step 1 by 128-bit fingerprints: the one of the smallest document goes
on, the others are repeated. A passage that half of the corpus shares reaches its group once per batch. Of a group that
continues beyond a batch of rows, only one suffix of each node is held; rows come by document, the smallest first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import written
from ._text import NOT_SPACE, Words, chunks, mix, ngrams, rolling, tidy

#: Words of a repeat, and of an anchor.
WINDOW, GRAM = 50, 12
#: Bytes of text in which a task settles equal suffixes at once.
BATCH_BYTES = 4 << 20
#: Suffixes of a group, above which its prefix is lengthened; also those that a tree is built of at once.
GROUP_ROWS = 1 << 16
#: Words that prefixes are lengthened to, below the window.
LENGTHS = (4, 16)
#: Suffixes of one row, at most: what a task holds beside a tree is some rows of them.
STRETCH = 256
#: Bytes of a word's hash in a tree.
_WIDTH = 5

_RUN = "key long, doc long, row long, check long, start int, size int, settled boolean"
_SEGMENT = "key long, doc long, row long, check long, start int, size int, words binary"


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def suffixes(offsets: np.ndarray, raw: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of the text, word number, anchor and label of every suffix of some consecutive texts."""
    words = Words(offsets, raw, NOT_SPACE)
    hashes = words.hashes()
    count = len(hashes) - window + 1
    none = np.zeros(0, np.int64)
    if count <= 0:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    inside = words.doc[:count] == words.doc[window - 1 :]
    at = np.flatnonzero(inside)
    anchors = least(ngrams(hashes, gram), window - gram + 1)
    labels = rolling(hashes, window)
    doc = words.doc[at]
    return doc, at - words.row[doc], anchors[at], labels[at]


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs in which the columns are constant and the last one ascends by one."""
    *same, step = columns
    if not len(step):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = step[1:] != step[:-1] + 1
    for c in same:
        new |= c[1:] != c[:-1]
    edge = np.flatnonzero(new) + 1
    return np.r_[0, edge], np.r_[edge, len(step)]


def _numbers(ids: pa.Array) -> np.ndarray:
    return ids.to_numpy(zero_copy_only=False).astype(np.int64)


def _first_runs(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Stretches of suffixes with one anchor that go on, and settled ones that are repeated (their key means nothing). `texts`: doc, row, check, t."""

    def own(doc: np.ndarray, row: np.ndarray, check: np.ndarray, offsets: np.ndarray, raw: np.ndarray) -> pa.RecordBatch | None:
        text, start, anchor, label = suffixes(offsets, raw, window, gram)
        if not len(text):
            return None
        order = np.lexsort((doc[text], label, anchor))
        a, b, d = anchor[order], label[order], doc[text[order]]
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        settled = np.zeros(len(text), bool)
        settled[order] = d > d[first][np.cumsum(first) - 1]
        out = []
        for done in (False, True):
            at = np.flatnonzero(settled == done)
            key = mix(row[text[at]].view(np.uint64)) if done else anchor[at]
            lo, hi = _runs(text[at], key, start[at])
            pick = at[lo]
            out.append((key[lo].view(np.int64), doc[text[pick]], row[text[pick]], check[text[pick]], start[pick].astype(np.int32), (hi - lo).astype(np.int32), np.full(len(lo), done)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["key", "doc", "row", "check", "start", "size", "settled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_numbers(batch.column(k)) for k in range(3)]
            for first, last, offsets, raw in chunks(batch.column(3), BATCH_BYTES):
                if (out := own(*(x[first:last] for x in ids), offsets, raw)) is not None:
                    yield out

    return texts.select("doc", "row", "check", "t").mapInArrow(tidy(run), _RUN)


def _segments(texts: DataFrame, runs: DataFrame, window: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the words of their stretch (`size` suffixes, and the window of the last one), of groups that fit and of those that do not;
    settled ones are among the former, without words."""
    own = runs.groupBy("row", "check").agg(F.collect_set(F.struct("key", "start", "size", "settled", "n")).alias("runs"))
    # the same columns of the texts and the same kind of join as in dedup, so that they are shuffled once for both
    both = texts.join(own.hint("merge"), ["row", "check"]).select(F.col("id").cast("long").alias("doc"), "row", "check", "t", "runs")

    def run(large: bool):
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [_numbers(batch.column(k)) for k in range(3)]
                for first, last, offsets, raw in chunks(batch.column(3), BATCH_BYTES):
                    words = Words(offsets, raw, NOT_SPACE)
                    codes = words.hashes().view(np.uint8).reshape(-1, 8)[:, :_WIDTH].tobytes()
                    lists = batch.column(4).slice(first, last - first)
                    inner = lists.flatten()
                    key, start, size, settled, n = (inner.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                    text = np.repeat(np.arange(last - first), np.diff(lists.offsets.to_numpy()))
                    begin = words.row[text] + start
                    use = np.flatnonzero((~settled & (n > group_rows)) if large else (settled | (n <= group_rows)))
                    # stretches of bounded size; of a large group single suffixes, whose group is that of their first words
                    most = np.where(settled[use], 1 << 30, 1 if large else STRETCH)
                    pieces = -(-size[use] // most)
                    use, most = np.repeat(use, pieces), np.repeat(most, pieces)
                    step = (np.arange(len(use)) - np.searchsorted(use, use)) * most
                    begin, start, size = begin[use] + step, start[use] + step, np.minimum(size[use] - step, most)
                    key, text, settled = key[use], text[use], settled[use]
                    use = np.arange(len(use))
                    blobs = [None if done else codes[_WIDTH * b : _WIDTH * (b + m + window - 1)] for b, m, done in zip(begin[use].tolist(), size[use].tolist(), settled[use].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[use]), *(pa.array(x[first:last][text[use]]) for x in ids), pa.array(start[use].astype(np.int32)), pa.array(size[use].astype(np.int32)), pa.array(blobs, pa.binary())],
                        names=["key", "doc", "row", "check", "start", "size", "words"],
                    )

        return emit

    return tuple(both.mapInArrow(tidy(run(large)), _SEGMENT) for large in (False, True))


def _lengthened(large: DataFrame, window: int, group_rows: int) -> DataFrame:
    """Single suffixes of groups that are too large, by a prefix as long as it takes."""
    lengths = [q for q in LENGTHS if q < window] + [window]
    rows = written(large.select("*", *(F.xxhash64("key", F.substring("words", 1, _WIDTH * q)).alias(f"k{q}") for q in lengths)))
    key: Column = F.col(f"k{window}")
    for q in reversed(lengths[:-1]):
        many = rows.groupBy(f"k{q}").agg(F.count("*").alias(f"n{q}"))
        rows = rows.join(many, f"k{q}")
        key = F.when(F.col(f"n{q}") <= group_rows, F.col(f"k{q}")).otherwise(key)
    return rows.select(key.alias("key"), "doc", "row", "check", "start", "size", "words")


class SuffixTree:
    """The suffix tree of some words, down to a depth: its leaves in order, and the words that each has in common with the one before.

    `leaves` has a row of bytes for each suffix: 8 of its group, `depth` times `_WIDTH` of its words. Suffixes of
    different groups have nothing in common.
    """

    def __init__(self, leaves: np.ndarray, depth: int):
        self.order = np.argsort(leaves.view(f"S{leaves.shape[1]}").ravel(), kind="stable")
        self.depth = depth
        a = leaves[self.order]
        differ = a[1:] != a[:-1]
        place = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
        self.common = np.concatenate([[0], np.maximum(place - 8, 0) // _WIDTH])[: len(a)]

    def deep_nodes(self) -> np.ndarray:
        """For each leaf, in order, the number of the node of full depth that it lies under."""
        return np.cumsum(self.common < self.depth) - 1


class _Groups:
    """Goes through sorted rows and says which suffixes lie under a node of a smaller document."""

    def __init__(self, window: int):
        self.window = window
        self._held(np.zeros((0, 8 + _WIDTH * window), np.uint8), np.zeros(0, np.int64))

    def _held(self, leaves: np.ndarray, doc: np.ndarray) -> None:
        self.leaves, self.doc = leaves, doc

    def step(self, columns: list[pa.Array], next_key: int | None) -> pa.RecordBatch:
        """Repeated stretches of some rows; `next_key` is the group of the row after them."""
        key, doc, row, check = (c.to_numpy() for c in columns[:4])
        start, size = (c.to_numpy().astype(np.int64) for c in columns[4:6])
        of = np.repeat(np.arange(len(key)), size)
        step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        text = np.frombuffer(b"".join(columns[6].to_pylist()), np.uint8)
        length = size + self.window - 1
        begin = (np.cumsum(length) - length)[of] + step
        every = np.lib.stride_tricks.as_strided(text, ((len(text) // _WIDTH) - self.window + 1, _WIDTH * self.window), (_WIDTH, 1))
        old = len(self.leaves)
        leaves = np.empty((old + len(of), 8 + _WIDTH * self.window), np.uint8)
        leaves[:old] = self.leaves
        leaves[old:, :8] = key.astype(">i8").view(np.uint8).reshape(-1, 8)[of]
        leaves[old:, 8:] = every[begin]
        docs = np.concatenate([self.doc, doc[of]])
        tree = SuffixTree(leaves, self.window)
        node = tree.deep_nodes()
        edge = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        least = np.minimum.reduceat(docs[tree.order], edge)
        small = np.empty(len(docs), np.int64)
        small[tree.order] = least[node]
        if next_key is not None and key[-1] == next_key:
            heads = tree.order[edge]
            own = (leaves[heads, :8] == leaves[-1, :8]).all(axis=1)
            self._held(leaves[heads[own]], least[own])
        else:
            self._held(leaves[:0], docs[:0])
        hit = np.flatnonzero(docs[old:] > small[old:])
        place = start[of] + step
        lo, hi = _runs(of[hit], place[hit])
        pick = hit[lo]
        return _run_rows(row[of[pick]], check[of[pick]], place[pick], hi - lo)


def _run_rows(row, check, start, size) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(check), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names=["row", "check", "start", "size"])


def _repeated(rows: DataFrame, window: int, group_rows: int) -> DataFrame:
    """(row, check, start, size): stretches of suffixes that also start in a smaller document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, many = _Groups(window), [], 0  # the last row waits for the next one's group
        for batch in batches:
            settled = batch.filter(batch.column(6).is_null())
            if settled.num_rows:
                yield _run_rows(*(settled.column(k).to_numpy() for k in (2, 3, 4, 5)))
            batch = batch.filter(batch.column(6).is_valid())
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                held.append(part)
                many += int(part.column(5).to_numpy().sum())
                if many < group_rows:
                    continue
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                if whole.num_rows > 1:
                    yield groups.step([whole.column(k).slice(0, whole.num_rows - 1) for k in range(7)], whole.column(0)[-1].as_py())
                held = [whole.slice(whole.num_rows - 1)]
                many = held[0].column(5)[0].as_py()
        if held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield groups.step([whole.column(k) for k in range(7)], None)

    return rows.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(tidy(run), "row long, check long, start int, size int")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, check, t): texts with 128 bits that stand for id and text, never null."""
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids are integers, not {kind}")
    same = [F.col(id_col), F.col(text_col)]
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(*same).alias("row"), F.xxhash64(F.lit("check"), *same).alias("check"), F.col(text_col).alias("t"))


def _repeats(texts: DataFrame, window: int, gram: int, group_rows: int) -> DataFrame:
    some = texts.filter("id is not null and t is not null").withColumn("doc", F.col("id").cast("long"))
    runs = _first_runs(some, window, gram)
    shared = runs.filter("not settled").groupBy("key").agg(F.sum("size").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most"))
    shared = written(shared.filter("least < most").select("key", "n"))
    met = runs.join(shared, "key", "left")
    met = met.filter("settled or n is not null").select("row", "check", "key", "start", "size", "settled", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    fits, large = _segments(texts, met, window, group_rows)
    if not shared.filter(F.col("n") > group_rows).isEmpty():
        fits = fits.unionByName(_lengthened(large, window, group_rows))
    return _repeated(fits, window, group_rows)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(row, check, start, size): windows `start` to `start + size - 1` of a text are repeated. row and check are the
    xxhash64 of (id, text) and of ("check", id, text). Rows without an id or text have none."""
    if not 0 < gram <= window:
        raise ValueError("an anchor lies within the window")
    return _repeats(_texts(docs, id_col, text_col), window, gram, group_rows)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256, kept.

    A word goes if a window of `window` words around it also starts in a document of smaller id; windows
    are judged on the input. A null or empty text has no words; a text of any length is taken whole. Rows of the same id do not
    remove each other's words, so repeated rows are all alike; a row without an id neither removes nor loses any. Ids are
    integers of any width; others raise ValueError. Other columns are not looked at, whatever their names; an empty
    table gives an empty result. `kept` is the remaining words joined by single spaces.
    """
    if not 0 < gram <= window:
        raise ValueError("an anchor lies within the window")
    texts = _texts(docs, id_col, text_col)
    runs = _repeats(texts, window, gram, group_rows).groupBy("row", "check").agg(F.collect_set(F.struct("start", "size")).alias("runs"))
    both = texts.join(runs.hint("merge"), ["row", "check"], "left").select("id", "t", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                total, gone, digest, kept = [], [], [], []
                for text, found in zip(part.column(1), part.column(2)):
                    words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                    total.append(len(words))
                    if spans := found.as_py():
                        mark = np.zeros(len(words) + 1, np.int64)
                        for x in spans:
                            mark[x["start"]] += 1
                            mark[x["start"] + x["size"] - 1 + window] -= 1
                        stay = np.cumsum(mark[:-1]) == 0
                        words = [w for w, s in zip(words, stay.tolist()) if s]
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                    digest.append(hashlib.sha256(kept[-1]).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array([x.decode("utf-8", "surrogatepass") for x in kept], pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256", "kept"])

    return both.mapInArrow(tidy(cut), f"{id_col} {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept_sha256 string, kept string")
