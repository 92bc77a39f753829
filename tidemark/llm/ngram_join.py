r"""N-gram Jaccard join with a prefix tree, and the components of its links.

A document is the set of its distinct 5-word shingles (64-bit hashes); a document of fewer words
is one shingle of all of them. Two documents link when their Jaccard similarity is at least
`percent` / 100. No link is lost at any step:

1. A sketch of fixed size counts, for every slot, the shingles of all documents that fall into it.
   (slot count, hash) is the global order: shingles that many documents share come last.
2. Documents of the same set are one class. Each class puts the first n - ceil(t n) + 1 shingles of its
   ordered set into postings; two linked sets have their first common shingle in both prefixes.
3. In a posting list, two classes are candidates if their sizes and their positions leave room
   for enough overlap. Only a forest over the candidates of a list leaves it.
4. Connected candidates that chance alone has tied are told apart by parity bitmaps, a bit or two a shingle: two sets differ in
   at least as many shingles as their bitmaps in bits. In a large corpus candidates grow into one component of most texts, and
   bitmaps are all of them that is dealt to every pair of its parts.
5. What remains connected forms a block. Each block's sets are stored in a prefix tree, shared shingles
   first. One traversal carries the overlaps of all sets of the block along the tree, adds the
   shingles of a node once for the whole subtree, and drops a set from a subtree as soon as the
   remaining lengths rule a link out. A block larger than BLOCK_SHINGLES is cut by size (and equal sizes by a hash) into
   parts, and every two of them whose sizes can link are joined, each pair of parts a task's work.
6. Links become components: few edges in one task, many by star rounds over a table of edges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import components, written
from ._text import LOWER, NOT_SPACE, Words, chunks, mix, ngrams, tidy

#: Words of a shingle, and the similarity in per cent.
WORDS, PERCENT = 5, 80
#: Slots of the sketch: 4 MB, whatever the corpus.
SLOTS = 1 << 20
_SLICE = 1 << 15
#: Shingles of one block of the join (8 bytes each), a set counting as ROW_SHINGLES at least; larger ones are joined by parts.
BLOCK_SHINGLES, ROW_SHINGLES = 250_000, 400
#: Bytes of bitmaps that are compared in one block, a set counting as MAP_ROW at least; larger components are compared by parts.
MAP_BYTES, MAP_ROW = 4 << 20, 512
#: Bits of the filter that says which texts the join needs: 16 for each, at most 16 MB; beyond that it lets more through.
FILTER_BITS = 1 << 27
#: Candidate pairs that a task gathers before it sends on what connects them.
PAIRS = 100_000
#: Posting lists up to this long are looked at pair by pair; in longer ones neighbours by size are tied.
LIST_ROWS = 4096


def shingle_sets(offsets: np.ndarray, raw: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(offsets, raw, NOT_SPACE, LOWER)
    hashes = words.hashes()
    grams = ngrams(hashes, n)
    row = words.row
    for k in range(len(offsets) - 1):
        lo, hi = row[k], row[k + 1]
        if hi - lo >= n:
            yield np.unique(grams[lo : hi - n + 1])
        elif hi > lo:  # the whole sequence as one, apart from any longer one
            yield mix(np.bitwise_xor.reduce(mix(hashes[lo:hi] + np.arange(1, hi - lo + 1, dtype=np.uint64)), keepdims=True) + np.uint64(hi - lo))
        else:
            yield np.zeros(0, np.uint64)


def identity(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a set as two signed longs."""
    a = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))
    b = mix(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    x, y = mix(np.array([a, b], np.uint64)).view(np.int64)
    return int(x), int(y)


def bitmap(s: np.ndarray) -> np.ndarray:
    """The parity of a set's shingles in each of as many places as it has shingles, rounded up to a power of two, 64 at least."""
    places = 1 << max(6, int(len(s) - 1).bit_length())
    odd = np.bincount((mix(s) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(maps: np.ndarray) -> np.ndarray:
    """Rows of bitmaps as they would be with half the places."""
    half = maps.shape[1] // 2
    return maps[:, :half] ^ maps[:, half:]


def alike(maps: list[np.ndarray], n: np.ndarray, sides: np.ndarray | None, percent: int) -> np.ndarray:
    """For each set the smallest index it is connected to, over the pairs whose sizes and bitmaps leave room for a link: all that link, and
    few others. With `sides`, only pairs of different sides are looked at."""
    order = np.argsort(n, kind="stable")
    size = n[order]
    width = np.array([len(maps[k]) for k in order], np.int64)
    widths, first = np.unique(width, return_index=True)
    groups = []  # (begin, end, the maps at their own width and at every lower one)
    for w, begin, end in zip(widths.tolist(), first.tolist(), [*first[1:].tolist(), len(n)]):
        levels = {w: np.array([maps[k] for k in order[begin:end]])}
        while w > widths[0]:
            levels[w // 2] = folded(levels[w])
            w //= 2
        groups.append((begin, end, levels))
    label = np.arange(len(n))
    side = None if sides is None else sides[order]
    last = np.searchsorted(size, 100 * size // percent, side="right")
    for i in range(len(n) - 1):
        w, own = int(width[i]), None
        for begin, end, levels in groups:
            lo, hi = max(begin, i + 1), min(int(last[i]), end)
            if end <= i or w not in levels:
                continue
            if begin <= i:
                own = levels[w][i - begin]
            if lo >= hi:
                continue
            others = levels[w]
            open_ = label[lo:hi] != label[i]
            if side is not None:
                open_ &= side[lo:hi] != side[i]
            at = np.flatnonzero(open_) + lo
            if len(at):
                differ = np.bitwise_count(others[at - begin] ^ own).sum(axis=1, dtype=np.int64)
                met = np.unique(label[at[differ <= size[i] + size[at] - 2 * _need(size[i], size[at], percent)]])
                if len(met):
                    met = np.append(met, label[i])
                    label[np.isin(label, met)] = met.min()
    least = np.full(len(n), len(n), np.int64)
    np.minimum.at(least, label, order)
    out = np.empty(len(n), np.int64)
    out[order] = least[label]
    return out


def in_order(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """A sorted set by (count of its slot, hash)."""
    return s[np.argsort(sketch[(s & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")]


def _sketch(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """Counts per slot over all documents. Each task sends its slices once, compressed; the sum has SLOTS counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, offsets, raw in chunks(batch.column(0)):
                sets = list(shingle_sets(offsets, raw, n))
                if sets:
                    slots = (np.concatenate(sets) & np.uint64(SLOTS - 1)).astype(np.int64)
                    total += np.bincount(slots, minlength=SLOTS)
        if total.any():
            small = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32).reshape(-1, _SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(small), dtype=np.int32)), pa.array([zlib.compress(x.tobytes(), 1) for x in small], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(c), np.int32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, np.iinfo(np.int32).max).astype(np.int32).tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    parts = docs.select(text).mapInArrow(tidy(count), schema).repartition(SLOTS // _SLICE, "slice").mapInArrow(tidy(add), schema)
    out = np.zeros(SLOTS, np.int32)
    for r in parts.toLocalIterator():  # SLOTS / _SLICE rows of fixed size
        out[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = np.frombuffer(r["counts"], np.int32)
    return out


def _described(docs: DataFrame, id_col: str, text: str, n: int, percent: int, sketch) -> DataFrame:
    """Per row: id, size of its set, its two digests, the ordered prefix and the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sketch.value
        for batch in batches:
            for first, last, offsets, raw in chunks(batch.column(1)):
                sizes, one, two, prefix, maps = [], [], [], [], []
                for s in shingle_sets(offsets, raw, n):
                    size = len(s)
                    a, b = identity(s) if size else (0, 0)
                    sizes.append(size)
                    one.append(a)
                    two.append(b)
                    prefix.append(in_order(s, order)[: size - -(-percent * size // 100) + 1].tobytes() if size else b"")
                    maps.append(bitmap(s).tobytes() if size else b"")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(prefix, pa.binary()), pa.array(maps, pa.binary())], names=["id", "n", "one", "check", "prefix", "map"])

    return docs.select(id_col, text).mapInArrow(tidy(run), f"id {dict(docs.dtypes)[id_col]}, n long, one long, check long, prefix binary, map binary")


def _postings(classes: DataFrame) -> DataFrame:
    """(token, node, n, pos) of each place of each class's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                raw = [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
                sizes = [len(x) for x in raw]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(raw)), pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.repeat(part.column(1).to_numpy().astype(np.int32), sizes)), pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in sizes]))],
                        names=["token", "node", "n", "pos"],
                    )

    return classes.select("node", "n", "prefix").mapInArrow(tidy(run), "token long, node long, n int, pos int")


def _need(a, b, percent: int):
    """The least overlap of two linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def _ties(node: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest over the pairs of one posting list (by size) that can link."""
    out: list[tuple[int, int]] = []
    left = n - pos
    label = np.arange(len(n))
    for i in range(len(n) - 1):
        top = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
        if top <= i + 1:
            continue
        j = slice(i + 1, top)
        ok = (np.minimum(left[i], left[j]) >= _need(n[i], n[j], percent)) & (label[j] != label[i])
        for k in np.flatnonzero(ok) + i + 1:
            if label[k] != label[i]:
                out.append((int(node[i]), int(node[k])))
                label[label == label[k]] = label[i]
    return out


def _forest(pairs: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs that connect what `pairs` connects, every node with the least one: the fewest rounds follow."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(root(x), x) for x in list(parent) if root(x) != x]


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that tie the classes of each posting list which can link.

    Lists are dealt by ranges of (token, size, node), so that one of any length is shared by as many tasks as it needs. A task
    holds one batch, and PAIRS pairs of which it sends on a forest. In a long list, and in the first and the last one of a task, which may go on
    in another, neighbours by size are tied: two sets that can link have only such ones between them. What ends one
    range and begins the next is tied after that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered, begin, end = [np.zeros(0, np.int64) for _ in range(4)], set(), None, None
        task = TaskContext.get().partitionId()

        def chain(node, n):
            near = np.flatnonzero(100 * n[:-1] >= percent * n[1:])
            return set(zip(node[near].tolist(), node[near + 1].tolist()))

        def lists(token, node, n, pos):
            edge = np.flatnonzero(token[1:] != token[:-1]) + 1
            start, stop = np.r_[0, edge], np.r_[edge, len(token)]
            size = stop - start
            two = start[(size == 2) & (token[start] != begin[0])]  # most lists: all at once
            ok = (np.minimum(n[two] - pos[two], n[two + 1] - pos[two + 1]) >= _need(n[two], n[two + 1], percent)) & (100 * n[two] >= percent * n[two + 1])
            out = set(zip(node[two[ok]].tolist(), node[two[ok] + 1].tolist()))
            for a, b in zip(start[size > 1], stop[size > 1]):
                if token[a] == begin[0] or b - a > LIST_ROWS:
                    out |= chain(node[a:b], n[a:b])
                elif b - a > 2:
                    out |= set(_ties(node[a:b], n[a:b], pos[a:b], percent))
            return out

        def rows(pairs):
            pairs = _forest(pairs)
            return _tied([p[0] for p in pairs], [p[1] for p in pairs])

        for batch in batches:
            held = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)]) for k, h in enumerate(held)]
            token = held[0]
            if not len(token):
                continue
            if begin is None:
                begin = tuple(int(h[0]) for h in held[:3])
            end = tuple(int(h[-1]) for h in held[:3])
            cut = int(np.searchsorted(token, token[-1]))  # the last list may go on in the next batch
            if cut:
                gathered |= lists(*(h[:cut] for h in held))
            elif len(token) > 4 * LIST_ROWS:  # a list longer than a batch; its last row ties it to the next ones
                gathered |= chain(held[1], held[2])
                cut = len(token) - 1 - 2 * LIST_ROWS  # its end stays, and is longer than LIST_ROWS
            held = [h[cut:] for h in held]
            if len(gathered) >= PAIRS:
                yield rows(gathered)
                gathered = set()
        if begin is not None:
            yield rows(gathered | chain(held[1], held[2]))
            yield _tied([begin[1], end[1]], [begin[2], end[2]], [2 * task, 2 * task + 1], [begin[0], end[0]])

    def _tied(a, b, place=None, token=None):
        none = [None] * len(a)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(place or none, pa.int64()), pa.array(token or none, pa.int64())], names=["a", "b", "place", "token"])

    ordered = postings.repartitionByRange("token", "n", "node").sortWithinPartitions("token", "n", "node")
    found = written(ordered.mapInArrow(tidy(run), "a long, b long, place long, token long"))
    # two rows of every task, in the order of the ranges: (node, size) of its first and its last posting
    along = Window.orderBy("place")
    ends = found.filter("place is not null").withColumn("t", F.lag("token").over(along)).withColumn("x", F.lag("a").over(along)).withColumn("m", F.lag("b").over(along))
    ends = ends.filter((F.col("place") % 2 == 0) & (F.col("token") == F.col("t")) & (100 * F.col("m") >= percent * F.col("b")))
    return found.filter("place is null").select("a", "b").union(ends.select(F.col("x").alias("a"), F.col("a").alias("b"))).distinct()


class Trie:
    """A prefix tree over sets, given as rows of ascending ranks; paths without branches are one node."""

    def __init__(self, rows: list[np.ndarray]):
        keys = [r.astype(">u4").tobytes() for r in rows]
        self.order = sorted(range(len(rows)), key=keys.__getitem__)  # leaf k holds set order[k]
        lengths = [len(rows[i]) for i in self.order]
        common = [0] * (len(rows) + 1)
        for k in range(1, len(rows)):
            a, b = rows[self.order[k - 1]], rows[self.order[k]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common[k] = int(differ[0]) if len(differ) else m
        self.root = self._build(common, lengths)

    def _build(self, common: list[int], lengths: list[int]):
        # a stack of open nodes [first leaf, depth, children, is a leaf]
        root = [0, 0, [], False]
        stack = [root]
        for k, size in enumerate(lengths):
            while stack[-1][1] > common[k]:
                last = stack.pop()
                if stack[-1][1] < common[k]:
                    stack.append([last[0], common[k], [last], False])
                    break
                stack[-1][2].append(last)
            if stack[-1][3]:  # the set before ends where this one goes on
                stack[-1] = [stack[-1][0], stack[-1][1], [stack[-1]], False]
            leaf = [k, size, [], True]
            if size == stack[-1][1]:
                stack[-1][2].append(leaf)
            else:
                stack.append(leaf)
        while len(stack) > 1:
            last = stack.pop()
            stack[-1][2].append(last)
        return root


def tree_join(sets: list[np.ndarray], weights: np.ndarray, sides: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set the smallest index it is connected to, and the summed weight of the sets it links with.

    With `sides`, only pairs of different sides are looked at.
    """
    count = len(sets)
    label, links = np.arange(count), np.zeros(count, np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(count), size)
    tokens, place, often = np.unique(np.concatenate(sets) if count else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)  # a shingle of one set alone adds to no overlap
    rank_of = np.full(len(tokens), -1, np.int64)
    rank_of[shared[np.argsort(-often[shared], kind="stable")]] = np.arange(len(shared))
    rank = rank_of[place]
    kept = rank >= 0
    owner, rank = owner[kept], rank[kept]
    by_set = np.lexsort((rank, owner))
    flat = owner[by_set] * (len(shared) + 1) + rank[by_set]  # ascending: (set, rank)
    begin = np.searchsorted(owner[by_set], np.arange(count + 1))
    ordered = rank[by_set]
    rows = [ordered[begin[k] : begin[k + 1]] for k in range(count)]
    have = np.diff(begin)  # shared shingles of each set
    by_token = np.lexsort((owner, rank))
    holders, first = owner[by_token], np.searchsorted(rank[by_token], np.arange(len(shared) + 1))
    trie = Trie(rows)
    leaf_size, leaf_have = size[trie.order], have[trie.order]

    # each entry: node, depth above it, sets still alive, their overlaps so far
    todo = [(trie.root, 0, count, np.arange(count), np.zeros(count, np.int64))]
    while todo:
        (lo, depth, children, _), above, hi, alive, overlap = todo.pop()
        if depth > above:
            segment = rows[trie.order[lo]][above:depth]
            found = np.zeros(count, np.int64)
            for r in segment:  # added once for the whole subtree
                found[holders[first[r] : first[r + 1]]] += 1
            overlap = overlap + found[alive]
            rest_set = begin[alive + 1] - np.searchsorted(flat, alive * (len(shared) + 1) + segment[-1], side="right")
        else:
            rest_set = have[alive]
        if not children:  # a leaf: its set's own sizes
            b = trie.order[lo]
            hit = alive[(overlap * (100 + percent) >= percent * (size[alive] + size[b])) & (alive != b)]
            if sides is not None:
                hit = hit[sides[hit] != sides[b]]
            if len(hit):
                links[b] += weights[hit].sum()
                names = np.unique(np.append(label[hit], label[b]))
                if len(names) > 1:
                    label[np.isin(label, names)] = names[0]
            continue
        rest_tree = leaf_have[lo:hi].max() - depth
        least, most = leaf_size[lo:hi].min(), leaf_size[lo:hi].max()
        ok = (overlap + np.minimum(rest_set, rest_tree) >= _need(size[alive], least, percent)) & (100 * size[alive] >= percent * least) & (percent * size[alive] <= 100 * most)
        alive, overlap = alive[ok], overlap[ok]
        if len(alive):
            ends = [c[0] for c in children[1:]] + [hi]
            # the largest subtree comes last, when nothing else needs its parent's overlaps: only a
            # logarithmic number of them is held however deep the tree is
            todo += sorted(((c, depth, e, alive, overlap) for c, e in zip(children, ends)), key=lambda x: x[0][0] - x[2])
    return label, links


def _refined(blocks: DataFrame, percent: int, limit: int) -> DataFrame:
    """(node, label) of the classes of candidate components (label, node, n, one, check, map) that may link with another one by their bitmaps,
    in what is still connected of each component. A component in one block is settled there, the others' parts are tied by rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            nodes = np.array([r[0] for r in rows], np.int64)
            label = alike([np.frombuffer(r[4], np.uint64) for r in rows], np.array([r[3] for r in rows], np.int64), np.array([r[1] for r in rows]) if rows[0][2] else None, percent)
            least = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(least, label, nodes)
            tied = np.bincount(label, minlength=len(rows))[label] > 1
            if tied.any():
                yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(least[label][tied]), pa.array([r[5] for r, t in zip(rows, tied) if t], pa.bool_())], names=["node", "label", "split"])

        for batch in batches:
            for block, *row in zip(*[batch.column(k).to_pylist() for k in range(7)]):
                if block != key:
                    if rows:
                        yield from finish()
                    key, rows = block, []
                rows.append(row)
        if rows:
            yield from finish()

    weight = F.greatest(F.length("map"), F.lit(min(MAP_ROW, limit // 8)))
    dealt = _blocks(blocks, percent, limit, weight, ["node", "n", "map"])
    dealt = dealt.select("block", "node", "side", "both", "n", "map", "split").repartition("block").sortWithinPartitions("block")
    found = written(dealt.mapInArrow(tidy(run), "node long, label long, split boolean"))
    split = found.filter("split").select(F.col("node").alias("a"), F.col("label").alias("b"))
    whole = found.filter("not split").select("node", "label")
    return whole if split.isEmpty() else whole.union(components(split))


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(hashes.view(np.uint64))
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _filter(ids: DataFrame, bits: int) -> np.ndarray:
    """Bytes in which two bits are set for each id. Tasks send the slices they have set; the result has bits / 8 bytes."""
    width = min(1 << 16, bits // 8)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for place in _places(batch.column(0).to_numpy(), bits):
                for k in range(8):
                    packed[place[place & 7 == k] >> 3] |= np.uint8(128 >> k)
        packed = packed.reshape(-1, width)
        used = np.flatnonzero(packed.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([packed[k].tobytes() for k in used], pa.binary())], names=["slice", "bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, np.uint8)
                sums[k] = sums[k] | part if k in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "bits"])

    schema = "slice int, bits binary"
    parts = ids.select(F.xxhash64("first")).mapInArrow(tidy(mark), schema).repartition("slice").mapInArrow(tidy(either), schema)
    out = np.zeros((bits // 8 // width, width), np.uint8)
    for r in parts.toLocalIterator():  # FILTER_BITS / 8 bytes at most
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _needed(docs: DataFrame, members: DataFrame, id_col: str, text: str) -> DataFrame:
    """(first, z) of the documents that are members, and few others: the rest need not be shuffled to be joined away.
    z is the compressed text, a third of the size of its shingles."""
    bits = int(min(FILTER_BITS, max(1 << 16, 1 << (16 * members.count()).bit_length())))
    held = docs.sparkSession.sparkContext.broadcast(_filter(members, bits))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = held.value
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for place in _places(batch.column(2).to_numpy(), bits):
                ok &= (flags[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            batch = batch.filter(pa.array(ok))
            packed = [zlib.compress(t.as_buffer(), 1) if t.is_valid else b"" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["first", "z"])

    texts = docs.select(F.col(id_col).alias("first"), F.col(text).alias("t"), F.xxhash64(id_col).alias("h"))
    return texts.mapInArrow(tidy(keep), f"first {dict(docs.dtypes)[id_col]}, z binary")


def _joined(members: DataFrame, docs: DataFrame, id_col: str, text: str, n: int, percent: int) -> DataFrame:
    """(node, label, links, split) of every class in every block. `members`: block, side, both, split, node, one and check (a set's digests), first (a row's id), docs."""
    found = members.join(_needed(docs, members, id_col, text), "first").select("block", "side", "both", "node", "one", "check", "docs", "z", "split")

    def sets(packed: list[bytes]) -> list[np.ndarray]:
        out = []
        for first in range(0, len(packed), 64):
            texts = pa.array([zlib.decompress(z) if z else b"" for z in packed[first : first + 64]], pa.large_binary()).cast(pa.large_string())
            for _, _, offsets, raw in chunks(texts):
                out += shingle_sets(offsets, raw, n)
        return out

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            # rows may share an id: the text must be the one of the class; and may be repeated
            got = {r[0]: (r, s) for r, s in zip(rows, sets([r[4] for r in rows])) if len(s) and identity(s) == r[5:7]}
            if not got:
                return
            nodes, own = list(got), [r for r, _ in got.values()]
            sides = np.array([r[1] for r in own]) if own[0][2] else None
            label, links = tree_join([s for _, s in got.values()], np.array([r[3] for r in own], np.int64), sides, percent)
            least: dict[int, int] = {}
            for k, x in enumerate(label.tolist()):
                least[x] = min(least.get(x, nodes[k]), nodes[k])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([least[x] for x in label.tolist()], pa.int64()), pa.array(links, pa.int64()), pa.array([r[7] for r in own], pa.bool_())], names=["node", "label", "links", "split"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(9)]
            for block, side, both, node, one, check, many, packed, split in zip(*columns):
                if block != key:
                    yield from finish()
                    key, rows = block, []
                rows.append((node, side, both, many, packed, one, check, split))
        yield from finish()

    return found.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(join), "node long, label long, links long, split boolean")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, n_links.

    component_id is the smallest id reachable by links, the own one included; n_links counts the
    other rows directly linked. A null or empty text, or one of white space alone, has the empty set
    and links with nothing. Equal rows link as any two of equal sets. A row without an id is counted
    (n_shingles) but links with nothing; its component_id is null. A text of any length is taken whole. Columns other than the two
    named are not looked at, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(_sketch(docs, text_col, words))
    described = _described(docs, id_col, text_col, words, percent, sketch)
    # the classes: equal sets, with one prefix each
    meta = written(described)
    classes = _classes(meta)
    edges = _candidates(_postings(classes), percent)
    blocks = _refined(components(edges).join(classes.select("node", "n", "one", "check", "map"), "node"), percent, MAP_BYTES)
    heads = classes.drop("prefix", "map")
    members = written(_blocks(blocks.join(heads, "node"), percent, block_shingles))
    parts = written(_joined(members, docs, id_col, text_col, words, percent).groupBy("node", "label", "split").agg(F.sum("links").alias("links")))
    # a component in one block is settled there
    labels, ties = parts.filter("not split").select("node", "label"), parts.filter("split and node <> label")
    if not ties.isEmpty():
        labels = labels.union(components(ties.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    named = heads.join(labels, "node")
    first = named.groupBy("label").agg(F.min("first").alias("component"))
    named = named.join(first, "label").select("node", "component")
    counted = parts.groupBy("node").agg(F.sum("links").alias("links"))
    summary = heads.join(named, "node", "left").join(counted, "node", "left").select(
        "one", "check", F.coalesce("component", "first").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("links")
    )
    # written, so that the last join is of two plain tables, and a class with very many copies can be split
    summary = written(summary)
    known = (F.col("n") > 0) & F.col("id").isNotNull()
    rows = meta.select("id", "n", F.when(known, F.col("one")).alias("one"), F.when(known, F.col("check")).alias("check"))
    return rows.join(summary, ["one", "check"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")
    )


def _classes(meta: DataFrame) -> DataFrame:
    """(node, one, check, n, first, prefix, map, docs) of each distinct set, by its 128 bits. Its node, the 64 bits that stand for it in edges,
    are the first of them; where sets share these (a few in 10^10 do) each has a number of its own."""
    known = meta.filter("n > 0 and id is not null")
    kept = [c for c in ("prefix", "map") if c in meta.columns]
    classes = known.groupBy("one", "check", "n").agg(F.min(F.struct("id", *kept)).alias("x"), F.count("*").alias("docs"))
    classes = classes.select("one", "check", "n", F.col("x.id").alias("first"), *[F.col(f"x.{c}").alias(c) for c in kept], "docs")
    shared = known.groupBy("one").agg((F.min("check") < F.max("check")).alias("shared")).filter("shared")
    if shared.isEmpty():
        return written(classes.withColumn("node", F.col("one")))
    own = F.when(F.col("shared"), F.xxhash64("one", "check")).otherwise(F.col("one"))
    return written(classes.join(shared, "one", "left").withColumn("node", own).drop("shared"))


def _blocks(members: DataFrame, percent: int, limit: int, weight: Column | None = None, carried: Sequence[str] = ("node", "one", "check", "first", "docs")) -> DataFrame:
    """(block, side, both, split, and what is carried): a component of candidates whole if it is small; a large one by parts,
    every two parts whose sizes can link being a block.

    A part is a range of set sizes, ranges being cut by the running total of what was counted for each size; sets of one size
    that alone are too many are dealt into several parts by a hash. No component is in one task.
    """
    weight = F.greatest("n", F.lit(min(ROW_SHINGLES, limit // 8))) if weight is None else weight
    total = members.groupBy("label").agg(F.sum(weight).alias("total"))
    sized = members.join(total, "label")
    small = sized.filter(F.col("total") <= limit).select(F.col("label").cast("string").alias("block"), F.lit(0).alias("side"), F.lit(False).alias("both"), F.lit(False).alias("split"), *carried)
    large = sized.filter(F.col("total") > limit)
    counted = large.groupBy("label", "n").agg(F.sum(weight).alias("held"))
    before = F.sum("held").over(Window.partitionBy("label").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")
    cut = counted.select("label", "n", F.floor(before / F.lit(limit / 2)).alias("range"), F.ceil(F.col("held") / F.lit(limit / 2)).alias("hands"))
    part = F.col("range") * 2 * limit + F.pmod(F.xxhash64("one", "check"), F.col("hands"))
    large = large.join(cut, ["label", "n"]).withColumn("part", part)
    ranges = large.groupBy("label", "part").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = ranges.select("label", F.col("part").alias("upper"), F.col("least").alias("upper_least"), F.col("most").alias("upper_most"))
    can_link = (F.col("upper_least") * percent <= F.col("most") * 100) & (F.col("least") * percent <= F.col("upper_most") * 100)
    reach = ranges.join(other, "label").filter((F.col("upper") >= F.col("part")) & can_link).select("label", F.col("part").alias("lower"), "upper")
    as_lower = large.join(reach.withColumnRenamed("lower", "part"), ["label", "part"]).withColumn("lower", F.col("part"))
    as_upper = large.join(reach.filter("lower < upper").withColumnRenamed("upper", "part"), ["label", "part"]).withColumn("upper", F.col("part"))
    pairs = as_lower.unionByName(as_upper, allowMissingColumns=True)
    split = pairs.select(F.concat_ws(":", "label", "lower", "upper").alias("block"), F.when(F.col("part") == F.col("lower"), 0).otherwise(1).alias("side"), (F.col("lower") != F.col("upper")).alias("both"), F.lit(True).alias("split"), *carried)
    return small.unionByName(split)
