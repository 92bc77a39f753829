r"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of ``[0-9A-Za-z]`` and non-ASCII characters, A-Z lower-cased. Every run of
`window` consecutive words of a benchmark item (the whole item if it is shorter) is a
pattern. Symbols of the automaton are words, as 64-bit hashes, so a pattern has at most `window` nodes; its edges are one
hash table from (node, word) to node. A text is cut into stretches that are scanned side by side, a word of each
at a time; a state depends on the last `window` words alone, with which every stretch begins. A hit maps back to word
numbers, and from there to offsets of the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import written
from ._text import LOWER, Words, byte_class, chunks, mix, tidy

#: Words of a pattern.
WINDOW = 10
#: Bytes of benchmark text that one automaton is built from (it has some 50 bytes for each); a larger benchmark is scanned in blocks
#: of this size, a pass each.
BLOCK_BYTES = 4 << 20

WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def normalise(text: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """The lower-cased words of ranges of texts (first, last, words)."""
    for first, last, offsets, raw in chunks(text):
        yield first, last, Words(offsets, raw, WORD, LOWER)


class Automaton:
    """The patterns of some items: edges, failure links, and what each node ends."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window = window
        self.names = sorted({i for i, _ in items}, key=lambda i: (i is not None, i))
        index = {i: k for k, i in enumerate(self.names)}
        patterns, sizes, owners = [], [], []
        bits = max(16, min(24, (4 * sum(len(t) for _, t in items)).bit_length()))
        self.pairs = np.zeros(1 << bits, bool)  # of words that follow each other in an item
        for first, last, words in normalise(pa.array([t for _, t in items], pa.large_string())):
            near = words.doc[1:] == words.doc[:-1]
            hashes = words.hashes()
            self.pairs[self._pair(hashes)[near]] = True
            hashes = np.concatenate([hashes, np.zeros(window, np.uint64)])
            own = np.array([index[i] for i, _ in items[first:last]], np.int32)
            many = np.diff(words.row)
            windows = np.where(many > 0, np.maximum(many - window + 1, 1), 0)
            item = np.repeat(np.arange(last - first), windows)
            begin = words.row[item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
            patterns.append(np.lib.stride_tricks.sliding_window_view(hashes, window)[begin])
            sizes.append(np.minimum(many[item], window))
            owners.append(own[item])
        pattern = np.concatenate(patterns) if patterns else np.zeros((0, window), np.uint64)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int32)

        # the trie, level by level: nodes are distinct (parent, word)
        node, parents, labels, levels = np.zeros(len(pattern), np.int64), [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)], [0, 1]
        for k in range(window):
            at = np.flatnonzero(size > k)
            order = at[np.lexsort((pattern[at, k], node[at]))]
            p, w = node[order], pattern[order, k]
            new = np.ones(len(order), bool)
            new[1:] = (p[1:] != p[:-1]) | (w[1:] != w[:-1])
            parents.append(p[new])
            labels.append(w[new])
            node[order] = levels[-1] + np.cumsum(new) - 1
            levels.append(levels[-1] + int(new.sum()))
        parent, label = np.concatenate(parents), np.concatenate(labels)
        total = len(parent)
        self.keys = np.zeros(1 << max(4, (2 * total - 1).bit_length()), np.uint64)
        self.target = np.zeros(len(self.keys), np.int32)
        self._fill(parent[1:], label[1:])
        self.known = np.zeros(1 << 20, bool)
        self.known[(label[1:] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

        # failure links, and the nearest node on them that ends a pattern
        self.fail = np.zeros(total, np.int32)
        for lo, hi in zip(levels[2:], levels[3:]):
            own, at = np.arange(lo, hi), self.fail[parent[lo:hi]].astype(np.int64)
            while len(own):
                found = self.step(at, label[own])
                self.fail[own[found > 0]] = found[found > 0]
                go = (found == 0) & (at > 0)
                own, at = own[go], self.fail[at[go]].astype(np.int64)
        self.single = bool((size == 1).any())
        # owners of the nodes that end patterns
        self.size_of = np.zeros(total, np.uint8)
        self.size_of[node] = size
        pairs = np.unique(node << 32 | owner) if len(node) else np.zeros(0, np.int64)
        self.owner_node, self.owner = pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.int32)
        self.shorter = np.zeros(total, np.int32)
        for lo, hi in zip(levels[1:], levels[2:]):
            f = self.fail[lo:hi]
            self.shorter[lo:hi] = np.where(self.size_of[f] > 0, f, self.shorter[f])

    @staticmethod
    def _key(state: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mix(word ^ (state.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)

    def _pair(self, words: np.ndarray) -> np.ndarray:
        """The place of each two neighbouring words in `pairs`."""
        return (mix(words[:-1] + mix(words[1:])) & np.uint64(len(self.pairs) - 1)).astype(np.int64)

    def _fill(self, state: np.ndarray, word: np.ndarray) -> None:
        """Nodes 1, 2, ... into the table of edges, each in the first free place from its own."""
        keys, mask = self._key(state, word), len(self.keys) - 1
        left, place = np.arange(len(keys)), (keys >> np.uint64(8)).astype(np.int64) & mask
        while len(left):
            free = np.flatnonzero(self.keys[place[left]] == 0)
            slot, one = np.unique(place[left[free]], return_index=True)
            put = left[free[one]]
            self.keys[slot], self.target[slot] = keys[put], put + 1
            stay = np.ones(len(left), bool)
            stay[free[one]] = False
            left = left[stay]
            place[left] = (place[left] + 1) & mask

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The node that each edge leads to, 0 where there is none."""
        keys, mask = self._key(state, word), len(self.keys) - 1
        place = (keys >> np.uint64(8)).astype(np.int64) & mask
        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        while len(left):
            have = self.keys[place]
            hit = have == keys
            out[left[hit]] = self.target[place[hit]]
            go = ~hit & (have != 0)
            left, keys, place = left[go], keys[go], (place[go] + 1) & mask
        return out

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def walk(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last word, node) of every pattern that ends in some texts; `starts` marks their first words.

        Where no pattern is a single word, one only occurs among words that follow each other in an item, too; others are left out first."""
        if self.single:
            return self._walk(words, starts)
        linked = np.zeros(len(words) + 1, bool)  # to the word before
        linked[1:-1] = self.pairs[self._pair(words)] & ~starts[1:] if len(words) else False
        at = np.flatnonzero(linked[:-1] | linked[1:])
        end, node = self._walk(words[at], ~linked[at])
        return at[end], node

    def _walk(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        known = self.known[(words & np.uint64((1 << 20) - 1)).astype(np.int64)]
        if len(self.fail) == 1 or not known.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        length = max(64, n // 1024)
        begin = np.arange(0, n, length) - (self.window - 1)
        state = np.zeros(len(begin), np.int64)
        ends, nodes = [], []
        for t in range(length + self.window - 1):
            at = begin + t
            lane = np.flatnonzero((at >= 0) & (at < n))
            here = at[lane]
            state[lane[starts[here] | ~known[here]]] = 0
            lane, here = lane[known[here]], here[known[here]]
            own = state[lane]
            word = words[here]
            to = self.step(own, word)
            back = np.flatnonzero((to == 0) & (own > 0))
            while len(back):
                own[back] = self.fail[own[back]]
                to[back] = self.step(own[back], word[back])
                back = back[(to[back] == 0) & (own[back] > 0)]
            state[lane] = to
            if t >= self.window - 1:
                hot = np.flatnonzero((self.size_of[to] > 0) | (self.shorter[to] > 0))
                while len(hot):
                    real = hot[self.size_of[to[hot]] > 0]
                    ends.append(here[real])
                    nodes.append(to[real])
                    to[hot] = self.shorter[to[hot]]
                    hot = hot[to[hot] > 0]
        return (np.concatenate(ends), np.concatenate(nodes)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def scan(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: first and last + 1 of each run of hit words; and (text, item) of each item with an occurring pattern."""
        starts = np.zeros(len(words.start) + 1, bool)
        starts[words.row[:-1]] = True
        end, node = self.walk(words.hashes(), starts[:-1])
        none = np.zeros(0, np.int64)
        if not len(end):
            return none, none, none, none
        mark = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(mark, end - self.size_of[node] + 1, 1)
        np.add.at(mark, end + 1, -1)
        hit = np.concatenate([[False], np.cumsum(mark)[:-1] > 0, [False]])
        # runs end where a text does
        first = hit[1:-1] & (~hit[:-2] | starts[:-1])
        last = hit[1:-1] & (~hit[2:] | np.append(starts[1:-1], True))
        pair = np.unique(words.doc[end].astype(np.int64) << 32 | node)
        text, node = pair >> 32, pair & 0xFFFFFFFF
        lo, hi = np.searchsorted(self.owner_node, node), np.searchsorted(self.owner_node, node, side="right")
        item = self.owner[np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())]
        pair = np.unique(np.repeat(text, hi - lo) << 32 | item)
        return np.flatnonzero(first), np.flatnonzero(last) + 1, pair >> 32, pair & 0xFFFFFFFF


_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_HITS = "words array<struct<first:long,last:long,start:long,end:long>>, who array<string>"


def _hits(automaton: Automaton, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[list[dict]], list[list[str | None]]]]:
    """Of ranges of texts: number of words, runs of hit words with code points of the original, items (a null stands for all without id)."""
    for first, last, offsets, raw in chunks(text):
        words = Words(offsets, raw, WORD, LOWER)
        spans, who = [[] for _ in range(last - first)], [[] for _ in range(last - first)]
        lo, hi, texts, items = automaton.scan(words)
        if len(lo):
            point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            doc = words.doc[lo]
            zero, base = point[offsets[doc]], words.row[doc]
            for d, *span in zip(doc.tolist(), (lo - base).tolist(), (hi - base).tolist(), (point[words.start[lo]] - zero).tolist(), (point[words.end[hi - 1]] - zero).tolist()):
                spans[d].append(dict(zip(("first", "last", "start", "end"), span)))
            for d, k in zip(texts.tolist(), items.tolist()):
                who[d].append(automaton.names[k])
        yield first, last, np.diff(words.row), spans, who


def merged(ranges: list[dict]) -> list[dict]:
    """The union of runs of words as disjoint runs in order."""
    out: list[dict] = []
    for r in sorted(ranges, key=lambda r: r["first"]):
        if out and r["first"] <= out[-1]["last"]:
            if r["last"] > out[-1]["last"]:
                out[-1] = out[-1] | {"last": r["last"], "end": r["end"]}
        else:
            out.append(r)
    return out


def _items(items: DataFrame, item_col: str, text_col: str, limit: int) -> tuple[DataFrame, int]:
    """(i, t, block) of the items, ids as strings, and the number of blocks of about `limit` bytes that they are dealt into by a hash."""
    items = items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    size = int(items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0])
    blocks = 1 if size <= limit else -(-size * 5 // (limit * 4))
    return items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))), blocks


def _automaton(items: DataFrame, block: int, window: int) -> Automaton:
    """Of one block, whose size was counted; made by the driver, so that workers get it built."""
    return Automaton(sorted(((r.i, r.t) for r in items.filter(F.col("block") == block).collect()), key=lambda x: (x[0] is not None, x[0], x[1])), window)


def _same_text(text_col: str) -> list:
    """128 bits that stand for a text, never null."""
    return [F.xxhash64(text_col).alias("one"), F.xxhash64(F.lit("check"), F.col(text_col)).alias("two")]


def _passes(docs: DataFrame, items: DataFrame, blocks: int, window: int, text_col: str) -> DataFrame:
    """(one, two, words, who) of the texts with hits, gathered from a pass for each block. Each pass is written, and its automaton let go, before the next."""
    spark, found = docs.sparkSession, []
    texts = docs.filter(F.col(text_col).isNotNull()).select(*_same_text(text_col), F.col(text_col).alias("t"))
    for block in range(blocks):
        held = spark.sparkContext.broadcast(_automaton(items, block, window))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, _, spans, who in _hits(held.value, batch.column(2)):
                    hit = pa.array([k for k, s in enumerate(spans) if s], pa.int64())
                    out = pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(spans, _SPAN), pa.array(who, pa.list_(pa.string()))], names=["one", "two", "words", "who"])
                    yield out.take(hit)

        found.append(written(texts.mapInArrow(tidy(run), f"one long, two long, {_HITS}").dropDuplicates(["one", "two"])))
        held.destroy()
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("one", "two").agg(F.flatten(F.collect_list("words")).alias("words"), F.array_distinct(F.flatten(F.collect_list("who"))).alias("who"))


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit, n_items, items_sha256, contaminated, items, offsets of hits.

    A null or empty text has no words; one of any length is scanned whole; equal rows give equal rows; columns other than the two
    named are not looked at, whatever their names; no documents give no rows. With an empty benchmark nothing is hit. Items that share
    an id are one item. Items without an id hit like others and count as one item, which `items` and the digest leave out, having no name.

    The benchmark's bytes are counted first; within `block_bytes` there is one automaton, broadcast, and one pass
    without a shuffle. A larger benchmark is cut into blocks, one automaton at a time; the hits of all passes, which are
    rows of hit texts only, are then joined to the documents by their texts.
    """
    spark: SparkSession = docs.sparkSession
    dealt, blocks = _items(items, item_col, item_text_col, block_bytes)
    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, offsets array<struct<start:long,end:long>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def rows(ids: pa.Array, n_words, spans: list[list[dict]], who: list[list[str | None]]) -> pa.RecordBatch:
        n_hit = [sum(r["last"] - r["first"] for r in s) for s in spans]
        names = [sorted(x for x in w if x is not None) for w in who]
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
        offsets = [[{"start": r["start"], "end": r["end"]} for r in s] for s in spans]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(w) for w in who], pa.int64()), pa.array(digests, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(names, pa.list_(pa.string())), pa.array(offsets, span)],
            names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "offsets"],
        )

    if blocks == 1:
        held = spark.sparkContext.broadcast(_automaton(dealt, 0, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, n_words, spans, who in _hits(held.value, batch.column(1)):
                    yield rows(batch.column(0).slice(first, last - first), n_words, spans, who)

        return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in normalise(batch.column(3)):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in range(3)), pa.array(np.diff(words.row))], names=["id", "one", "two", "n_words"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch.column(0), batch.column(1), [merged(x or []) for x in batch.column(2).to_pylist()], [x or [] for x in batch.column(3).to_pylist()])

    counted = docs.select(F.col(id_col).alias("id"), *_same_text(text_col), F.col(text_col).alias("t")).mapInArrow(tidy(count), f"id {kind}, one long, two long, n_words long")
    both = counted.join(_passes(docs, dealt, blocks, window, text_col), ["one", "two"], "left")
    return both.select("id", "n_words", "words", "who").mapInArrow(tidy(join), schema)


def drop(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, in which no window of an item occurs: those that `scan` calls not contaminated.

    A null or empty text stays, as does every row where the benchmark is empty; equal texts stay or go together; columns of any name
    pass unchanged. One pass without a shuffle for a benchmark within `block_bytes`; for a larger one a pass for each block, then
    one join that leaves out texts with hits.
    """
    dealt, blocks = _items(items, item_col, item_text_col, block_bytes)
    at, schema = docs.columns.index(text_col), docs.schema
    if blocks > 1:
        hit = _passes(docs, dealt, blocks, window, text_col).select("one", "two")
        same = (F.xxhash64(docs[text_col]) == hit["one"]) & (F.xxhash64(F.lit("check"), docs[text_col]) == hit["two"])
        return docs.join(hit, same, "left_anti")
    held = docs.sparkSession.sparkContext.broadcast(_automaton(dealt, 0, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, _, spans, _ in _hits(held.value, batch.column(at)):
                yield batch.slice(first, last - first).filter(pa.array([not s for s in spans], pa.bool_()))

    return docs.mapInArrow(tidy(run), schema)
