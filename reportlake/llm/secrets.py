"""Operator 6: secrets in texts and in what the texts encode.

Every whole text is scanned for three kinds: assign, access and hex (the fixed patterns below). Then a worklist unwraps
it until nothing new appears: percent escapes and Unicode escapes are undone over a whole layer, base64 runs one by one
(a decoded run that is gzip, zlib or zstandard data is decompressed); lines of base64 are also one run. Where a run as a
whole is no base64 of a text, because words are glued to the blob, it is decoded from each of its first four characters,
and every readable stretch and every compressed piece is a layer. Every new layer is scanned and unwrapped again. A
layer whose text and place were seen before is not taken twice, so cycles end. A span found in a layer is mapped back
through all layers to the code points of the text that encode it. Spans of the text itself always stay.

Defined results: null and empty texts have no span (and the sha256 of the empty string); repeated rows and repeated or
null doc_ids give a row each; an empty table gives an empty result; extra columns are ignored. Bytes of an escape run that
are no UTF-8 stay as they are. A part of a base64 run that does not decode to ``SHORTEST`` bytes of printable text (the
shortest secret) or to compressed data of such text is no layer. Compressed data is read to its end, through all its gzip or
zlib members and zstandard frames, in pieces of ``PIECE`` bytes that share ``OVERLAP`` bytes, each of them a layer; what
stands around a border in more than ``OVERLAP`` bytes is read from its two parts. Bytes after the last whole member are left.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from io import StringIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from reportlake.llm.common import lean

KINDS = ("assign", "access", "hex")
PIECE = 1 << 25
OVERLAP = 1 << 20
_FEED = 1 << 10
# fixed values: the patterns of the contract
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MARKS = ("passw", "secret", "token", "api")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[^ \t\r\n]+")
SHORTEST = 12
_READABLE = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){%d,}+" % SHORTEST)
_PACKED = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd|[\x08\x18\x28\x38\x48\x58\x68\x78]")
_PRINTABLE = bytes(range(32, 127)) + b"\t\n\r"


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the spans of one layer. A run of the access or hex class is one match, so asking
    for its length in the pattern equals dropping short matches."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(m in low for m in _MARKS):
            found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class _Layer:
    """A text and where its code points come from: runs (pos, start, step), in which code point pos + k stands for the
    code points [start + k * step, start + (k + 1) * step) of the root text; or one root span for all of them."""

    __slots__ = ("text", "pos", "start", "step", "span")

    def __init__(self, text: str, span=None):
        self.text, self.span = text, span
        self.pos, self.start, self.step = array("q"), array("q"), array("q")

    def add(self, pos: int, start: int, step: int) -> None:
        """A run from ``pos`` on, unless it goes on with the last one."""
        if self.pos and self.step[-1] == step and self.start[-1] + (pos - self.pos[-1]) * step == start:
            return
        self.pos.append(pos)
        self.start.append(start)
        self.step.append(step)

    def _at(self, i: int, k: int) -> int:
        return self.start[k] + (i - self.pos[k]) * self.step[k]

    def root(self, start: int, end: int) -> tuple[int, int]:
        if self.span:
            return self.span
        a, b = bisect_right(self.pos, start) - 1, bisect_right(self.pos, end - 1) - 1
        return self._at(start, a), self._at(end, b)

    def copy(self, to: _Layer, at: int, a: int, b: int) -> None:
        """Runs of the code points [a, b), which stand from ``at`` on in ``to``."""
        k = bisect_right(self.pos, a) - 1
        while a < b:
            end = min(b, self.pos[k + 1]) if k + 1 < len(self.pos) else b
            to.add(at, self._at(a, k), self.step[k])
            at, a, k = at + end - a, end, k + 1


def _undo(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The layer with every match of ``pattern`` replaced by its decoded code points."""
    out, text, at, n = _Layer("", layer.span), None, 0, 0

    def keep(a: int, b: int) -> None:
        nonlocal n
        text.write(layer.text[a:b])
        if not layer.span and a < b:
            layer.copy(out, n, a, b)
        n += b - a

    for m in pattern.finditer(layer.text):
        decoded = decode(m[0])
        if decoded is None:
            continue
        text = StringIO(newline="") if text is None else text
        keep(at, m.start())
        for char, a, b in decoded:
            text.write(char)
            if not layer.span:
                s, e = layer.root(m.start() + a, m.start() + b)
                out.add(n, s, e - s)
            n += 1
        at = m.end()
    if text is None:
        return None
    keep(at, len(layer.text))
    out.text = text.getvalue()
    return out


def _percent(run: str) -> Iterable[tuple[str, int, int]] | None:
    """Each escaped code point with its place in the run; bytes that aren't UTF-8 stay escaped. None if all do."""
    text = bytes.fromhex(run.replace("%", "")).decode(errors="surrogateescape")
    return _places(run, text) if any(not "\udc80" <= c <= "\udcff" for c in text) else None


def _places(run: str, text: str) -> Iterator[tuple[str, int, int]]:
    at = 0
    for c in text:
        if "\udc80" <= c <= "\udcff":
            yield from _kept(run, at, 3)
            at += 3
        else:
            n = 3 * (1 if c < "\x80" else len(c.encode()))
            yield c, at, at + n
            at += n


def _kept(run: str, at: int, n: int) -> list[tuple[str, int, int]]:
    return [(run[i], i, i + 1) for i in range(at, at + n)]


def _unicode(run: str) -> Iterable[tuple[str, int, int]] | None:
    if run.startswith("\\u") and run[2] != "{":
        return _units(run) if any(c != 1 for c, _, _ in _code_units(run)) else None
    if run[0] == "&":
        code = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
    else:
        code = int(run[2:].strip("{}"), 16)
    return [(chr(code), 0, len(run))] if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _code_units(run: str) -> Iterator[tuple[str | int, int, int]]:
    """(character, or 1 for half a surrogate pair, start, end) of each escape in a run of four-digit ones."""
    i = 0
    while i < len(run):
        code, n = int(run[i + 2 : i + 6], 16), 6
        if 0xD800 <= code < 0xDC00 and i + 12 <= len(run):
            low = int(run[i + 8 : i + 12], 16)
            if 0xDC00 <= low < 0xE000:
                code, n = 0x10000 + (code - 0xD800 << 10) + (low - 0xDC00), 12
        yield 1 if 0xD800 <= code < 0xE000 else chr(code), i, i + n
        i += n


def _units(run: str) -> Iterator[tuple[str, int, int]]:
    for c, a, b in _code_units(run):
        if c == 1:
            yield from _kept(run, a, b - a)
        else:
            yield c, a, b


def _members(data: memoryview) -> Iterator[bytes]:
    """Decompressed chunks of all gzip or zlib members or zstandard frames that follow one another; ends at what is none."""
    at = 0
    while at < len(data):
        if data[at : at + 4] == b"\x28\xb5\x2f\xfd":
            unpack = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
        elif data[at : at + 2] == b"\x1f\x8b" or len(data) - at > 2 and data[at] & 15 == 8 and int.from_bytes(data[at : at + 2]) % 31 == 0:
            unpack = zlib.decompressobj(47)
        else:
            return
        while not unpack.eof and at < len(data):
            feed = data[at : at + _FEED]
            try:
                out = unpack.decompress(feed)
            except (zlib.error, zstandard.ZstdError):
                return
            at += len(feed) - len(unpack.unused_data)
            if out:
                yield out


def _inflate(data: bytes | memoryview) -> Iterator[bytes]:
    """Decompressed data in pieces that overlap; nothing if it is not compressed."""
    piece = bytearray()
    for chunk in _members(memoryview(data)):
        piece += chunk
        while len(piece) >= PIECE:
            yield bytes(piece[:PIECE])
            del piece[: PIECE - OVERLAP]
    if piece:
        yield bytes(piece)


def _inner(data: bytes | memoryview) -> Iterator[str]:
    """The printable pieces behind compressed data."""
    for k, piece in enumerate(_inflate(data)):
        if (text := _text(_whole(piece, k > 0, len(piece) >= PIECE))) is not None:
            yield text


def _whole(piece: bytes, head: bool, tail: bool) -> bytes:
    """A piece without the halves of code points at its cut ends."""
    a, b = 0, len(piece)
    while head and a < min(3, b) and piece[a] & 0xC0 == 0x80:
        a += 1
    if tail:
        for k in range(1, min(4, b - a) + 1):
            c = piece[b - k]
            if c & 0xC0 != 0x80:
                b -= k if c >= 0xC0 and (2 if c < 0xE0 else 3 if c < 0xF0 else 4) > k else 0
                break
    return piece[a:b]


def _base64(run: str) -> list[str]:
    """The printable texts behind a base64 run, directly or compressed."""
    bare = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 == 1:
        return []
    try:
        data = base64.b64decode(bare + "=" * (-len(bare) % 4))
    except (binascii.Error, ValueError):
        return []
    if next(_members(memoryview(data)), None) is not None:
        return list(_inner(data))
    return [] if (text := _text(data)) is None else [text]


def _text(data: bytes) -> str | None:
    if data.translate(None, _PRINTABLE):
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return None
        return text if sum(c.isprintable() or c.isspace() for c in text) >= 0.95 * len(text) else None
    return data.decode()


def _decoded(run: str) -> Iterator[tuple[str, int, int]]:
    """(text, start, end): what a base64 run encodes as a whole, else what its parts encode."""
    if whole := _base64(run):
        yield from ((text, 0, len(run)) for text in whole)
        return
    bare = run.rstrip("=").replace("-", "+").replace("_", "/")
    for first in range(4):
        n = len(bare) - first
        n -= n % 4 == 1
        data = base64.b64decode(bare[first : first + n] + "=" * (-n % 4))
        view = memoryview(data)
        for m in _PACKED.finditer(data):
            for text in _inner(view[m.start() :]):
                yield text, first + m.start() * 4 // 3, len(run)
        for m in _READABLE.finditer(data):
            yield m[0].decode("utf-8", "ignore"), first + m.start() * 4 // 3, first + -(-m.end() * 4 // 3)


def secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(spans of the text itself, all spans), each (start, kind number, end) in order."""
    if not text:
        return [], []
    base = scan(text)
    top = _Layer(text)
    top.add(0, 0, 1)
    found, work, seen = set(base), [top], set()
    while work:
        layer = work.pop()
        new = []
        if "%" in layer.text:
            new.append(_undo(layer, _PERCENT, _percent))
        if "\\" in layer.text or "&#" in layer.text:
            new.append(_undo(layer, _UNICODE, _unicode))
        for m in _BASE64.finditer(layer.text):
            new += [_Layer(inner, span=layer.root(m.start() + a, m.start() + b)) for inner, a, b in _decoded(m[0])]
        for m in _WRAPPED.finditer(layer.text) if "\n" in layer.text else ():
            lines = _Layer("")  # places in the run without line breaks to places in the layer
            n = 0
            for line in _LINE.finditer(m[0]):
                lines.add(n, m.start() + line.start(), 1)
                n += len(line[0])
            run = "".join(m[0].split())
            new += [_Layer(inner, span=layer.root(*lines.root(a, b))) for inner, a, b in _decoded(run)]
        for child in new:
            if child is None:
                continue
            key = (child.span, hashlib.blake2b(child.text.encode("utf-8", "replace"), digest_size=16).digest())
            if key in seen:
                continue
            seen.add(key)
            work.append(child)
            for s, kind, e in scan(child.text):
                a, b = child.root(s, e)
                found.add((a, kind, b))
    return base, sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the text's own spans by kind, their digest, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                base, spans = secrets(t.as_py())
                counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)
