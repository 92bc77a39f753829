r"""Secret scan with structural confirmation.

Base patterns (kinds ``assign``, ``access``, ``hex``) are reported as they match.
On top of them, runs of base64 or hex are decoded and parsed; they are reported
only if the bytes have the nested structure of a key or a signed token:

* ``der``: an ASN.1 SEQUENCE whose nested lengths fill the bytes exactly and whose
  parts are those of a PKCS#1, PKCS#8 (encrypted or not) or SEC1 private key (base64, PEM body or hex),
* ``openssh``: ``openssh-key-v1`` followed by length-prefixed fields that fit (base64, PEM body or hex),
  both wherever they start in a run; a key ends where its lengths say. A run may go over several lines, whose
  breaks may be escaped, in armour or without.
* ``jwt``: three base64url parts; the header is a JSON object naming an algorithm, from the start of its
  part or, where other characters are glued to it, from the brace that matches its last one; the payload is a JSON
  object, the signature decodes (it is empty for ``none`` alone).

Lengths are followed without decoding what they span, and every part of a text is looked at a fixed number of times: the scan is
linear in the text. Offsets are code points of the original text, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import tidy

KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINT = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}+={0,2}")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:[A-Za-z0-9+/=\s]|\\+[nrt])*+)-----END \1-----")
_HEADER = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{12})[A-Za-z0-9_-]++(?=\.[A-Za-z0-9_-]++\.)")
_REST = re.compile(r"\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+(?:\r?\n|(?:\\+r)?\\+n)[ \t]*+)++(?:[A-Za-z0-9+/_-]++={0,2})?")
_BREAK = re.compile(r"\s+|\\+[nrt]")
# Starts of a DER SEQUENCE of any form of length that goes on with a version (02 01), or that soon names an
# object of the arc 2a 86 48 86 f7 0d 01, as they are in base64, for each place in a group of four, and in hex.
_BY_FOUR = "[AEIMQUYcgkosw048]"
_START64 = re.compile(rf"M(?=[A-H]{_BY_FOUR}CA[Q-f]|I(?:[E-H].Ag[E-H]|[I-L]..[AQgw]IB|[M-P].{{3}}{_BY_FOUR}CA[Q-f]|[Q-T].{{5}}Ag[E-H])|[A-P].{{2,24}}?(?:KoZIhvcNAQ|SIb3DQE|hkiG9w0B))")
_START_HEX = re.compile(r"30(?=(?:[0-7].|81..|82.{4}|83.{6}|84.{8})(?:0201|30(?:[0-7].|81..)06..2[aA]864886[fF]70[dD]01))")
_MAGIC = b"openssh-key-v1\0"
_MAGIC64, _MAGIC_HEX = "b3BlbnNzaC1rZXktdjE", re.compile(_MAGIC.hex(), re.I)
_ONE_MAGIC64, _ALL_HEX, _LINE = re.compile(_MAGIC64), re.compile("[0-9A-Fa-f]+"), re.compile(r"[A-Za-z0-9+/_=-]+")
_BRACE, _TOKEN_START = re.compile(rb"[{}]"), re.compile("e[yw]")
# password-based encryption: the arcs of PKCS#5 and of PKCS#12
_ENCRYPTED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: Bytes of the shortest key that is looked for without armour.
LEAST_KEY = 24

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The contract's matches. A failing match is dropped after it has used up its characters."""
    out: list[Span] = []
    low = text.lower() if "=" in text or ":" in text else ""
    if any(h in low for h in _HINT):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def _decode64(run: str) -> bytes | None:
    body = _BREAK.sub("", run).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


#: Gives n bytes from a place on, fewer where there are no more.
Reader = Callable[[int, int], bytes]


def _reader64(run: str, start: int) -> Reader:
    """Bytes of base64 (of either alphabet) that starts at `start`, decoded where they are read."""

    def read(at: int, n: int) -> bytes:
        part = run[start + at // 3 * 4 : start - (-(at + n) // 3) * 4].replace("-", "+").replace("_", "/")
        part = part[:-1] if len(part) % 4 == 1 else part
        return base64.b64decode(part + "=" * (-len(part) % 4))[at % 3 : at % 3 + n]

    return read


def _reader_hex(run: str, start: int) -> Reader:
    def read(at: int, n: int) -> bytes:
        try:
            return bytes.fromhex(run[start + 2 * at : start + 2 * (at + n)])
        except ValueError:  # not hex, or half a byte
            return b""

    return read


def _tlv(read: Reader, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value at `at`; None unless it lies within `end`."""
    head = read(at, 6)
    if len(head) < 2 or at + 2 > end:
        return None
    tag, n = head[0], head[1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or len(head) < 2 + k:
            return None
        n = int.from_bytes(head[2 : 2 + k], "big")
        at += k
    return (tag, at, at + n) if at + n <= end else None


def der_size(read: Reader, room: int) -> int:
    """Bytes of the private key that starts where `read` does and lies within `room`, its nested lengths filling it exactly; 0 if none does."""
    top = _tlv(read, 0, room)
    if not top or top[0] != 0x30:
        return 0
    parts, at = [], top[1]
    while at < top[2]:
        part = _tlv(read, at, top[2])
        if not part or len(parts) == 10:  # no key has more parts
            return 0
        parts.append(part)
        at = part[2]
    tags = [p[0] for p in parts]

    def algorithm(part: tuple[int, int, int]) -> bytes:
        oid = _tlv(read, part[1], part[2])
        return read(oid[1], min(oid[2] - oid[1], 16)) if oid and oid[0] == 0x06 else b""

    if tags == [0x30, 0x04]:  # encrypted PKCS#8: algorithm, then what it gives
        return top[2] if algorithm(parts[0]).startswith(_ENCRYPTED) else 0
    if tags[:1] != [0x02] or parts[0][2] - parts[0][1] != 1:  # version
        return 0
    if tags[1:3] == [0x30, 0x04]:  # PKCS#8: algorithm, then the key
        return top[2] if algorithm(parts[1]) else 0
    if tags[1:2] == [0x04]:  # SEC1
        return top[2] if parts[1][2] - parts[1][1] in (24, 28, 32, 48, 66) else 0
    return top[2] if len(tags) >= 9 and set(tags[:9]) == {0x02} else 0  # PKCS#1


def openssh_size(read: Reader, room: int) -> int:
    """Bytes of the OpenSSH private key that starts where `read` does, up to the end of its private part (all where that does not fit);
    0 unless its fields up to a public key fit."""
    if read(0, len(_MAGIC)) != _MAGIC:
        return 0

    def after(at: int, fields: int) -> int:
        for _ in range(fields):
            n = read(at, 4)
            if len(n) < 4 or at + 4 + int.from_bytes(n, "big") > room:
                return 0
            at += 4 + int.from_bytes(n, "big")
        return at

    at = after(len(_MAGIC), 3)
    keys = int.from_bytes(read(at, 4), "big") if at and at + 4 <= room else 0
    if not 1 <= keys <= 16 or not after(at + 4, 1):
        return 0
    return after(at + 4, keys + 1) or room


def _reader(data: bytes) -> Reader:
    return lambda at, n: data[at : at + n]


def is_der_key(data: bytes) -> bool:
    """True for a private key whose nested lengths fill `data` exactly."""
    return bool(data) and der_size(_reader(data), len(data)) == len(data)


def is_openssh_key(data: bytes) -> bool:
    """True for an OpenSSH private key file body whose length-prefixed fields fit."""
    return openssh_size(_reader(data), len(data)) > 0


def _object(part: str) -> dict | None:
    """The JSON object that a base64url part decodes to."""
    try:
        out = json.loads(_decode64(part) or b"")
    except (ValueError, RecursionError):  # RecursionError: very deep nesting
        return None
    return out if isinstance(out, dict) else None


def _header(part: str) -> tuple[int, dict] | None:
    """Where the JSON header that a part ends with starts, and the header."""
    if (h := _object(part)) is not None and isinstance(h.get("alg"), str):
        return 0, h
    starts = []
    for off in range(4):
        data = _decode64(part[off:])
        if not data or not data.rstrip().endswith(b"}"):
            continue
        braces = [m.start() for m in _BRACE.finditer(data)]
        depth = 0
        for k in reversed(braces):
            depth += 1 if data[k] == 0x7D else -1
            if not depth:
                if k % 3 == 0:
                    starts.append(off + k // 3 * 4)
                break
    for a in sorted(starts):
        if (h := _object(part[a:])) is not None and isinstance(h.get("alg"), str):
            return a, h
    return None


def _tokens(text: str) -> list[Span]:
    """Compact signed tokens with a header that names its algorithm."""
    out: list[Span] = []
    for m in _HEADER.finditer(text):
        if not _TOKEN_START.search(m[0]) or not (found := _header(m[0])):
            continue
        rest = _REST.match(text, m.end())
        unsigned = found[1]["alg"].lower() == "none"
        signed = not rest[2] if unsigned else bool(rest[2]) and _decode64(rest[2]) is not None
        if signed and _object(rest[1]) is not None:
            out.append((m.start() + found[0], rest.end(), "jwt"))
    return out


def _end64(run: str, start: int, size: int) -> int:
    """Where `size` bytes of base64 from `start` end, their padding included."""
    end = start - (-size * 4 // 3)
    return len(run) if end < len(run) and not run[end:].strip("=") else end


def _keys_in(run: str) -> list[Span]:
    """Keys that start anywhere in a run, each as long as its own lengths say."""
    out: list[Span] = []
    body = run.rstrip("=")

    def search(pattern: re.Pattern, hexed: bool, measure: Callable[[Reader, int], int], kind: str) -> None:
        at = 0
        while m := pattern.search(body, at):
            a, at = m.start(), m.start() + 1
            room = (len(body) - a) // 2 if hexed else (len(body) - a) * 3 // 4
            size = measure((_reader_hex if hexed else _reader64)(body, a), room)
            if size < (LEAST_KEY if hexed else LEAST_KEY * 3 // 4):
                continue
            if not hexed:
                end = len(run) if kind == "openssh" and size == room else _end64(run, a, size)
            else:
                end, found = a + 2 * size, body[a : a + 2 * size]
                if not _ALL_HEX.fullmatch(found) or found not in (found.lower(), found.upper()):
                    continue
            out.append((a, end, kind))
            at = end

    search(_START64, False, der_size, "der")
    search(_START_HEX, True, der_size, "der")
    if _MAGIC64 in body:
        search(_ONE_MAGIC64, False, openssh_size, "openssh")
    search(_MAGIC_HEX, True, openssh_size, "openssh")
    return out


def _keys_over_lines(text: str) -> list[Span]:
    """Keys in lines of base64 or hex, one below the other, without armour."""
    out: list[Span] = []
    for m in _LINES.finditer(text):
        lines = [(x.start(), x.end()) for x in _LINE.finditer(_BREAK.sub(lambda b: " " * len(b[0]), m[0]))]
        sums = [0]
        for a, b in lines:
            sums.append(sums[-1] + b - a)

        def place(k: int) -> int:
            n = bisect.bisect_right(sums, k) - 1
            return m.start() + lines[n][0] + k - sums[n]

        out += [(place(a), place(b - 1) + 1, kind) for a, b, kind in _keys_in("".join(m[0][a:b] for a, b in lines))]
    return out


def confirmed_spans(text: str) -> list[Span]:
    """Spans of base64 or hex that decode to the structure of a key or a signed token."""
    out: list[Span] = []
    if "-----BEGIN " in text:
        for m in _ARMOUR.finditer(text):
            data = _decode64(m[2])
            kind = data and ("der" if is_der_key(data) else "openssh" if is_openssh_key(data) else None)
            if kind:
                out.append((m.start(), m.end(), kind))
    if "ey" in text or "ew" in text:
        out += _tokens(text)
    over = list(out)
    for m in _RUN.finditer(text):
        out += [(m.start() + a, m.start() + b, kind) for a, b, kind in _keys_in(m[0])]
    if "\n" in text or "\\n" in text:
        lines = _keys_over_lines(text)
        over += lines
        out += lines
    return _outermost(out, over)


def _outermost(spans: list[Span], over: list[Span]) -> list[Span]:
    """Spans other than those of keys inside another one of `over`."""
    wide = sorted({(a, -b) for a, b, kind in over})
    starts, reach = [a for a, _ in wide], []
    for a, b in wide:
        reach.append(max(-b, reach[-1] if reach else 0))
    own = {(a, -b) for a, b in wide}

    def inside(s: Span) -> bool:
        n = bisect.bisect_right(starts, s[0])
        if s[2] == "jwt" or not n or reach[n - 1] < s[1]:
            return False
        return (s[0], s[1]) not in own or any(a <= s[0] and s[1] <= b and (a, b) != s[:2] for a, b in own)

    return [s for s in spans if not inside(s)]


def ordered(spans: list[Span]) -> list[Span]:
    """By start, then kind as listed, then end."""
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in ordered(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every (merged) span replaced by ``[SECRET]``."""
    out, at = [], 0
    for a, b, _ in ordered(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, all spans as an array, and the digest columns.

    A null text is empty, an empty text has no span, equal rows give equal rows, an
    empty table an empty result; a text of any length is scanned whole, in time linear in it; other columns are not looked at,
    whatever their names. One pass, no shuffle.
    """
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>"
    found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, details = ([], [], []), [], [], []
            for text in batch.column(1):
                t = text.as_py() or ""
                base = base_spans(t)
                every = base + confirmed_spans(t)
                for n, kind in zip(counts, BASE):
                    n.append(sum(s[2] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                details.append([{"kind": k, "start": a, "end": b} for a, b, k in ordered(every)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(details, found)],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"],
            )

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every secret in its text replaced, all rows and columns kept, whatever their names; a null text stays null, an
    empty one empty, equal rows stay equal, a text of any length is scanned whole. One pass, no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() for x in batch.column(at))
            out = [t if not t or not (s := base_spans(t) + confirmed_spans(t)) else redacted(t, s) for t in texts]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)
