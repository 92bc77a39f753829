"""SentencePiece encoding and decoding by a streaming Viterbi search.

A lattice over the characters is walked once. Every position keeps its best last piece; a
piece reaches back at most L characters (the longest piece), so only the last L positions can
be continued. As soon as the backpointer paths of all of them meet in one boundary, the pieces
before it are final and are committed, so the window stays of bounded size.

Two kinds of model share the walk:

* unigram: the best last piece is the one with the highest total score,
* BPE: merges are not a sum of scores, so the plain score search would segment differently.
  Here an edge is allowed only if its two pieces, joined, would be segmented by the merges into the
  very same two pieces. A sequence whose neighbours all fulfil this is the one the merges
  give, and each position has exactly one such last piece; the search is exact.

Where no piece of the vocabulary bridges two character classes, all paths meet at every border
between them, so what lies before is committed there without a search. The units in between go through the window;
the ids of those met last are remembered, so that a unit that comes again is not walked again.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import tidy

SPACE = "▁"
#: Units whose ids a worker remembers in each of two generations; when the younger is full, the older one goes.
CACHE_UNITS = 250_000
#: Characters of a text in which units are looked for at once.
PORTION = 1 << 16
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) pairs of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        wire = key & 7
        if wire == 0:
            value, at = varint(at)
        elif wire == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif wire == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        yield key >> 3, value


class Model:
    """A vocabulary with its scores and the settings of its normaliser.

    Only identity normalisation is supported; other rules raise ValueError rather than give other ids.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = UNIGRAM, dummy_prefix: bool = True, trim: bool = False):
        self.pieces, self.kind, self.dummy_prefix, self.trim = pieces, kind, dummy_prefix, trim
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.score = [s for _, s, _ in pieces]
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.longest = max([1, *map(len, self.ids)])
        self.edges = ahocorasick.Automaton()  # the lattice: pieces by their ends
        for p in self.ids:
            self.edges.add_word(p, p)
        self.edges.make_automaton()
        lowest = min([0.0, *(self.score[i] for i in self.ids.values())])
        self.penalty = lowest - 10.0  # of a character outside the vocabulary
        self.bytes_of = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in pieces]
        self._pair: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self.cut = self._cut()

    @classmethod
    def parse(cls, data: bytes) -> Model:
        """From the bytes of a .model file."""
        pieces, kind, dummy, trim, charsmap = [], UNIGRAM, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                charsmap, dummy, trim = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        if kind not in (UNIGRAM, BPE) or charsmap:
            raise ValueError("only unigram and BPE models with identity normalisation are supported")
        if any(t == USER for _, _, t in pieces):
            raise ValueError("models with user-defined symbols are not supported")
        return cls(pieces, kind, dummy, trim)

    def _cut(self) -> re.Pattern | None:
        """Cuts text into units that no piece reaches across; None if the vocabulary has no such borders."""

        letter = re.compile(r"[^\W\d_]")
        moved: set[str] = set()  # letters that pieces join to other characters, such as superscript digits

        def cls(c: str) -> str:
            return "_" if c == SPACE else "d" if c in "0123456789" else "\n" if c == "\n" else "a" if letter.match(c) and c not in moved else "o"

        def bridges() -> set[tuple[str, str, str]]:
            return {(cls(a), cls(b), a if cls(a) == "a" else b) for p in self.ids for a, b in zip(p, p[1:])}

        moved |= {c for a, b, c in bridges() if {a, b} == {"a", "o"}}
        left = {(a, b) for a, b, _ in bridges()}
        if len(moved) > 64 or any(a != "_" and a != b for a, b in left):
            return None
        also = re.escape("".join(sorted(moved)))
        digits, lines = ("[0-9]" + "+" * (("d", "d") in left), "\n" + "+" * (("\n", "\n") in left))
        return re.compile(rf"{SPACE}*(?:[^\W\d_{also}]+|{digits}|{lines}|(?:(?![{SPACE}\n0-9])[\W\d_{also}])+)|{SPACE}+")

    # -- normalisation -------------------------------------------------------------

    def normalise(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        text = text.replace(" ", SPACE)
        return SPACE + text if self.dummy_prefix else text

    # -- the lattice ---------------------------------------------------------------

    def _merges(self, text: str) -> list[str]:
        """The segmentation by merges of a short text, step by step."""
        parts = list(text)
        while True:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _allowed(self, a: str, b: str) -> bool:
        if (a, b) not in self._pair:
            if len(self._pair) > 250_000:
                self._pair.clear()
            self._pair[a, b] = self._merges(a + b) == [a, b]
        return self._pair[a, b]

    def _reachable(self, piece: str) -> bool:
        if piece not in self._whole:
            self._whole[piece] = len(self._merges(piece)) == 1
        return self._whole[piece]

    def stream(self, text: Iterable[str]) -> Iterator[str]:
        """Pieces of a normalised text, given in strings of any length; yields them as they are final."""
        window = _Window(self)
        for part in text:
            yield from window.push(part)
        yield from window.end()

    def _extend_merges(self, tail: str, back: list[int], total: list[float]) -> None:
        """Last pieces of the positions of `tail` that have none yet; the one allowed piece, or a single character."""
        first, settled = len(back), -1
        back.extend(range(first - 1, len(tail)))
        low = max(0, first - self.longest)
        ids, pair, whole = self.ids, self._pair, self._whole
        for at, piece in self.edges.iter(tail[low:] if low else tail):  # by end, the longest first
            end = at + low + 1
            if end == settled or end < first:
                continue
            start = end - len(piece)
            if start:  # a path that starts at a committed boundary has its left neighbour settled already
                left = tail[back[start] : start]
                fits = pair.get((left, piece))
                if fits is None:
                    fits = left not in ids or self._allowed(left, piece)
                if not fits:
                    continue
            if whole.get(piece) or self._reachable(piece):
                back[end] = start
                settled = end

    def _extend_scores(self, tail: str, back: list[int], total: list[float]) -> None:
        """Best last pieces of the positions of `tail` that have none yet; the longest of equal ones."""
        first = len(back)
        low = max(0, first - self.longest)
        found: list[list[str]] = [[] for _ in range(len(tail) + 1)]
        for at, piece in self.edges.iter(tail[low:]):
            found[at + low + 1].append(piece)
        for end in range(first, len(tail) + 1):
            best, start = None, end - 1
            for piece in found[end]:
                value = total[end - len(piece)] + self.score[self.ids[piece]]
                if best is None or value > best:
                    best, start = value, end - len(piece)
            if best is None:  # a character outside the vocabulary is a piece of its own
                best = total[end - 1] + self.penalty
            total.append(best)
            back.append(start)

    def _meeting(self, back: list[int], keep: int) -> int:
        """The last boundary that the paths of all positions that can still be continued pass through."""
        live = {p for p in range(max(0, len(back) - keep), len(back))}
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(back[last])
        return live.pop()

    # -- ids -----------------------------------------------------------------------

    def unit_ids(self, unit: str) -> list[int]:
        """The ids of a normalised text that no piece reaches out of, walked in one window after another."""
        window = _Window(self)
        out: list[int] = []
        for piece in (*window.push(unit), *window.end()):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in piece.encode("utf-8", "replace")]
            elif not out or out[-1] != self.unknown:  # a run of unknown characters is one id
                out.append(self.unknown)
        return out

    def units(self, norm: str) -> Iterator[str]:
        """The units of a normalised text, found in portions of bounded size. All paths meet at their borders, so each is committed on its own."""
        tail = ""
        for at in range(0, len(norm), PORTION):
            found = self.cut.findall(tail + norm[at : at + PORTION])
            tail = found.pop() if at + PORTION < len(norm) and found else ""  # may go on in the next portion
            yield from found

    def encode(self, text: str, memory: Memory | None = None) -> np.ndarray:
        """The ids of a text as int32."""
        norm = self.normalise(text)
        if not norm:
            return np.zeros(0, np.int32)
        if self.cut is None or not self.byte:
            return np.asarray(self.unit_ids(norm), np.int32)
        memory = Memory(self) if memory is None else memory
        return np.frombuffer(b"".join(map(memory.young.__getitem__, self.units(norm))), np.int32)

    def decode(self, ids: Iterable[int | None]) -> str:
        """The text of ids; a null has none. Byte pieces are joined before they are read as UTF-8. An id outside the vocabulary raises ValueError."""
        table = self.bytes_of
        ids = [i for i in ids if i is not None]
        if ids and not (0 <= min(ids) and max(ids) < len(table)):
            raise ValueError(f"ids are from 0 to {len(table) - 1}")
        raw = b"".join([table[i] for i in ids])
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


class _Window:
    """The walk along one text: characters from the last committed boundary on, and what leads to each of their positions.

    It takes the text in steps of the longest piece. After each, only the last L positions can be continued; where the paths of all
    of them have met, the pieces before are final and leave the window.
    """

    def __init__(self, model: Model):
        self.model, self.step = model, model.longest
        self.tail = ""
        self.back = [0]  # start of the best last piece up to each position of tail
        self.total = [0.0]  # and the best score; unigram only
        self.extend = model._extend_merges if model.kind == BPE else model._extend_scores

    def push(self, part: str) -> list[str]:
        """The pieces that are final once `part` is read."""
        out: list[str] = []
        step = self.step
        for at in range(0, len(part), step):
            self.tail += part[at : at + step]
            self.extend(self.tail, self.back, self.total)
            if len(self.tail) > 2 * step and (done := self.model._meeting(self.back, step)):
                out += self._pieces(done)
                self.tail, self.total = self.tail[done:], self.total[done:]
                self.back = [0, *(x - done for x in self.back[done + 1 :])]
        return out

    def end(self) -> list[str]:
        return self._pieces(len(self.tail))

    def _pieces(self, end: int) -> list[str]:
        out = []
        tail, back = self.tail, self.back
        while end:
            out.append(tail[back[end] : end])
            end = back[end]
        out.reverse()
        return out


class _Young(dict):
    """Ids of units as bytes; asks for what it lacks."""

    def __init__(self, memory: Memory):
        super().__init__()
        self.memory = memory

    def __missing__(self, unit: str) -> bytes:
        m = self.memory
        ids = m.old.get(unit)
        if ids is None:
            ids = np.asarray(m.model.unit_ids(unit), np.int32).tobytes()
        if len(unit) <= 64:  # longer ones hardly come again
            if len(self) >= CACHE_UNITS:
                m.old = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class Memory:
    """Two generations of remembered units, of bounded size."""

    def __init__(self, model: Model):
        self.model, self.old = model, {}
        self.young = _Young(self)


_loaded: dict[str, tuple[Model, Memory]] = {}


def _model(key: str, data: bytes) -> tuple[Model, Memory]:
    if key not in _loaded:
        _loaded.clear()
        model = Model.parse(data)
        _loaded[key] = model, Memory(model)
    return _loaded[key]


def read_model(spark, path: str) -> bytes:
    """The bytes of a model file, from any store that Spark reads; a plain local path is read by the driver."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_tokens, ids, n_chars of the decoded text, round_trip.

    A null or empty text has no ids and decodes to the empty text; one of any length is walked whole; equal rows give equal rows;
    other columns are not looked at, whatever their names; an empty table gives an empty result. round_trip says that decoding gives the text back as it was. (Lone
    surrogates and the like cannot occur in a Spark string.) One pass, no shuffle; the model's
    bytes (the size of a vocabulary) are broadcast.
    """
    import hashlib

    data = read_model(docs.sparkSession, model_path)
    key = hashlib.sha256(data).hexdigest()
    Model.parse(data)  # fail early
    held = docs.sparkSession.sparkContext.broadcast(data)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens long, ids array<int>, n_chars long, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = _model(key, held.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids, chars, same = [], [], []
                for text in part.column(1):
                    t = text.as_py() or ""
                    one = model.encode(t, memory)
                    back = model.decode(one.tolist())
                    ids.append(one)
                    chars.append(len(back))
                    same.append(back == (t if not model.trim else model.normalise(t)[model.dummy_prefix :].replace(SPACE, " ")))
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(chars, pa.int64()), pa.array(same, pa.bool_())],
                    names=[id_col, "n_tokens", "ids", "n_chars", "round_trip"],
                )

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of `tokens`: id and text. A null array gives a null text, no ids the empty text; a null among ids is left out, an
    id outside the vocabulary (a negative one is) raises ValueError. Equal rows give equal rows; other columns are not looked
    at. One pass, no shuffle."""
    import hashlib

    data = read_model(tokens.sparkSession, model_path)
    key = hashlib.sha256(data).hexdigest()
    held = tokens.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _model(key, held.value)
        for batch in batches:
            out = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return tokens.select(id_col, ids_col).mapInArrow(tidy(run), f"{id_col} {dict(tokens.dtypes)[id_col]}, text string")
