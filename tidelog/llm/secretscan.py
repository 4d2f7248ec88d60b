"""Secret scans with a recursive decoding worklist.

The base patterns are matched in the text itself. Then encoded regions are unwrapped: percent-encoding, Unicode and
character escapes, base64 (also over line breaks) and, below it, gzip, zlib, bzip2 and Zstandard, all members and any number of
levels. Each unwrapped layer goes on a worklist, is scanned by the same patterns, and is searched for further encoded regions,
until no new layer turns up. A layer that was seen before at the same place ends its branch (cycle detection). Spans found in a
layer are mapped to the text: through the position of each character for percent-encoding and escapes, to the whole encoded region
for base64 and compressed data.

Escapes of escapes (``%2525...``) give two layers, that of one step and that of all steps, which is found in one pass however many
steps there are. Bytes are read as UTF-8, where they aren't as Latin-1, and with many zero bytes also as UTF-16. What a region
unwraps to is read in pieces of about ``PIECE`` characters, cut where no encoded region is, each with the last ``OVERLAP``
characters before it; so no amount of data is too much, and what is held is a piece and the longest encoded region in it.
Compressed data inside compressed data is held whole.

Compressed data that is damaged or cut off gives all that decodes before the byte at which it breaks, and what follows is read as it
is. Such regions are listed in ``broken``, so that no text passes for one without secrets because it couldn't be read. Any other fault
(a decoder that isn't installed, no memory) is an error of the job.

Defined results: null is an empty text; without matches the digests are those of the empty string and spans is ''; each row
is scanned by itself, so repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, count

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, texts_in

#: The base patterns, in the order of their kinds, and the least length of a match or of its value.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_VALUE, MIN_ACCESS = 8, 16

#: Characters of a decoded layer that are scanned at once, and how many before them are seen again.
PIECE, OVERLAP = 4_000_000, 4096
#: Bytes that a decoder takes and gives at once. Where it breaks, what the call before gave is followed by calls of the next sizes.
STEPS = ((1 << 16, 1 << 20), (1 << 10, 1 << 13), (1 << 5, 1 << 7), (1, 1))
#: The widest window that Zstandard can decode; a frame that states a window takes memory as it is filled.
MOST_WINDOW = 1 << 31
PADDING = re.compile(rb"\0*")
PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[a-z]{2,6};")
LONGEST_ESCAPE = 10
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
WRAPPED_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Where a layer may be cut: a character of no encoded region.
CUT = re.compile(r"[^A-Za-z0-9+/_=\\%&;#{}\r\n \t-]")


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every base match, by kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


@dataclass
class Layer:
    """Unwrapped text and where in the document each of its characters comes from: one place for all, or one each."""

    text: str
    start: int
    end: int
    places: list[tuple[int, int]] | None = None
    stepped: str = ""  # the kind of escapes that it is decoded from; those it still has are decoded beside it
    inner: bool = False  # under a base64 region, to which all its places are mapped

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.places is None:
            return self.start, self.end
        return self.places[a][0], self.places[b - 1][1]


@dataclass
class Found:
    base: list[tuple[str, int, int]] = field(default_factory=list)
    spans: list[tuple[str, int, int]] = field(default_factory=list)
    layers: int = 0
    broken: list[tuple[int, int]] = field(default_factory=list)


class _Broken(Exception):
    """Data that begins as compressed data but doesn't decode to its end."""


def _compressed(data: bytes, at: int = 0) -> str | None:
    """The format that the first bytes tell."""
    head = data[at : at + 4]
    if head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] == 0x78 and (head[0] << 8 | head[1]) % 31 == 0):
        return "zlib"
    if head[:3] == b"BZh":
        return "bzip2"
    if head[1:] == b"\x2a\x4d\x18" and head[0] >> 4 == 5:
        return "skippable"
    return "zstd" if head == b"\x28\xb5\x2f\xfd" else None


def _stream(kind: str, data: bytes, at: int) -> Iterator[bytes]:
    """What the zlib or bzip2 stream at a place gives, in blocks; returns where it ends.

    A decoder that breaks keeps back what its last call had decoded. The stream is then read again with the calls that went well and
    smaller ones after them. Of a bzip2 block of a wrong checksum the very last byte isn't to be had from the decoder.
    """
    went: list[tuple[int, int]] = []
    done, last = 0, bytearray()
    for step in STEPS:
        stream = zlib.decompressobj(47) if kind == "zlib" else bz2.BZ2Decompressor()
        k, given = at, 0
        try:
            for call in count():
                size, most = went[call] if call < len(went) else step
                fed = data[k : k + size] if getattr(stream, "needs_input", True) else b""
                block = stream.decompress(fed, most)
                if call == len(went):
                    went.append(step)
                k += len(fed) - len(getattr(stream, "unconsumed_tail", b""))
                given += len(block)
                if given > done:
                    done = given
                    if step is STEPS[0]:
                        yield block
                    else:
                        last += block
                if stream.eof:
                    return k - len(stream.unused_data)
                if not block and not fed:
                    raise _Broken
        except (zlib.error, OSError) as e:  # bzip2's is an OSError
            if str(e).startswith("Error -4 "):
                raise MemoryError(str(e)) from e
    if last:
        yield bytes(last)
    raise _Broken


def _frame(data: bytes, at: int) -> Iterator[bytes]:
    """What the Zstandard frame at a place gives, block by block; returns where it ends."""
    import zstandard

    try:
        head = data[at : at + 18]
        k, checksum = at + zstandard.frame_header_size(head), zstandard.get_frame_parameters(head).has_checksum
        stream = zstandard.ZstdDecompressor(max_window_size=MOST_WINDOW).decompressobj()
        last = False
        while not last:
            x = int.from_bytes(data[k : k + 3], "little")
            last, size = bool(x & 1), 1 if x >> 1 & 3 == 1 else x >> 3
            k += 3 + size
            if block := stream.decompress(data[at:k]):
                yield block
            if k > len(data):
                raise _Broken
            at = k
        if checksum:
            k += 4
            if block := stream.decompress(data[at:k]):
                yield block
    except zstandard.ZstdError as e:
        if "not enough memory" in str(e):
            raise MemoryError(str(e)) from e
        raise _Broken from e
    if k > len(data):
        raise _Broken
    return k


def _inflate(data: bytes, ends: list[bool]) -> Iterator[bytes]:
    """What compressed data unwraps to, in blocks: all members or streams, and what else follows them, or from the one on that breaks.

    To ``ends`` goes for each of them whether it was whole.
    """
    at, aside = 0, []
    while at < len(data) and (kind := _compressed(data, at)):
        try:
            if kind == "skippable":  # no part of the content, so it comes after it
                end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
                if end > len(data):
                    raise _Broken
                aside += [b"\n", data[at + 8 : end]]
            else:
                end = yield from _frame(data, at) if kind == "zstd" else _stream(kind, data, at)
        except _Broken:
            ends.append(False)
            yield b"\n" + data[at:]
            at = len(data)
            break
        ends.append(True)
        at = PADDING.match(data, end).end()  # files may be padded
    if at < len(data):
        yield data[at:]
    if aside:
        yield b"".join(aside)


def _contents(data: bytes, ends: list[bool]) -> Iterator[bytes]:
    """The innermost content of data that may be compressed, any number of times."""
    seen = set()
    while _compressed(data):
        mark = hashlib.blake2b(data, digest_size=16).digest()
        if mark in seen:
            return
        seen.add(mark)
        blocks = _inflate(data, ends)
        first = next(blocks, None)
        if first is None:
            break
        if _compressed(first) is None:
            yield first
            yield from blocks
            return
        data = first + b"".join(blocks)
    yield data


def _decoded(blocks: Iterator[bytes]) -> Iterator[str]:
    """UTF-8, and Latin-1 for blocks that aren't."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    for block in blocks:
        pending = decoder.getstate()[0]
        try:
            yield decoder.decode(block)
        except UnicodeDecodeError:
            decoder.reset()
            yield (pending + block).decode("latin-1")
    if rest := decoder.getstate()[0]:
        yield rest.decode("latin-1")


def _pieces(texts: Iterator[str]) -> Iterator[str]:
    """Texts that follow each other as pieces of about PIECE characters, each with the end of the one before."""
    held, sought = "", PIECE
    for text in texts:
        held += text
        while len(held) > sought:
            cut = CUT.search(held, sought)
            if cut is None:
                sought = len(held)
                break
            yield held[: cut.end()]
            held, sought = held[cut.end() - OVERLAP :], PIECE
    if held:
        yield held


def _texts(data: bytes, ends: list[bool]) -> Iterator[str]:
    yield from _pieces(_decoded(_contents(data, ends)))
    if data.count(0) >= len(data) // 4 > 0:
        yield data.decode("utf-16-le", "replace")


def _unbase64(run: str, ends: list[bool]) -> Iterator[str]:
    core = run.rstrip("=")
    if len(core) % 4 != 1:
        try:
            data = base64.b64decode(core.replace("-", "+").replace("_", "/") + "=" * (-len(core) % 4), validate=True)
        except (binascii.Error, ValueError):
            return
        yield from _texts(data, ends)


def _wrapped(text: str) -> Iterator[tuple[str, int, int]]:
    """(joined run, start, end) of base64 that spans lines: all lines of a block, and lines of one width with those around them."""
    for m in WRAPPED.finditer(text):
        lines = [(x[0], m.start() + x.start(), m.start() + x.end()) for x in WRAPPED_LINE.finditer(m[0])]
        ranges, at = {(0, len(lines)): None}, 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or len(lines[k][0]) != len(lines[at][0]):
                for a in {max(0, at - 1), at}:
                    for b in {k, min(len(lines), k + 1)}:
                        if b - a > 1:
                            ranges[a, b] = None
                at = k
        for a, b in ranges:
            run = "".join(x[0] for x in lines[a:b])
            if len(run) >= 16:
                yield run, lines[a][1], lines[b - 1][2]


def _plain(parts: list[tuple[int | str, int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """Characters, and bytes that are read as UTF-8 together, with the range of each in the line: text and places."""
    out, places, k = [], [], 0
    while k < len(parts):
        x, a, b = parts[k]
        if isinstance(x, str):
            out.append(x)
            places.append((a, b))
            k += 1
            continue
        e = k
        while e < len(parts) and not isinstance(parts[e][0], str):
            e += 1
        for c in bytes(p[0] for p in parts[k:e]).decode("utf-8", "replace"):
            size = len(c.encode()) if c != "\ufffd" else 1
            out.append(c)
            places.append((parts[k][1], parts[min(k + size, e) - 1][2]))
            k = min(k + size, e)
        k = e
    return "".join(out), places


def _unpercent(line: str, whole: bool = False) -> tuple[str, list[tuple[int, int]]]:
    """One step of decoding, or with ``whole`` all steps in one pass: text, and for each of its characters its range in the line."""
    parts: list[tuple[int | str, int, int]] = []
    if not whole:
        at = 0
        for m in PERCENT.finditer(line):
            parts.extend((line[k], k, k + 1) for k in range(at, m.start()))
            x = int(m[0][1:], 16)
            parts.append((x if x > 127 else chr(x), *m.span()))
            at = m.end()
        parts.extend((line[k], k, k + 1) for k in range(at, len(line)))
        return _plain(parts)
    digits = "0123456789abcdefABCDEF"
    for k, c in enumerate(line):
        parts.append((c, k, k + 1))
        while len(parts) > 2 and parts[-3][0] == "%" and isinstance(parts[-1][0], str) and parts[-1][0] in digits and isinstance(parts[-2][0], str) and parts[-2][0] in digits:
            x = int(parts[-2][0] + parts[-1][0], 16)
            new = (x if x > 127 else chr(x), parts[-3][1], parts[-1][2])
            del parts[-3:]
            parts.append(new)
    return _plain(parts)


def _character(escape: str) -> str:
    try:
        return html.unescape(escape) if escape[0] == "&" else chr(int(escape.strip("\\uUx{}"), 16))
    except (ValueError, OverflowError):
        return escape


def _unescape(line: str, whole: bool = False) -> tuple[str, list[tuple[int, int]]]:
    """The same for escapes. In one pass, an escape is decoded as soon as it is complete, also where it is made of decoded characters."""
    parts: list[tuple[str, int, int]] = []
    if not whole:
        at = 0
        for m in ESCAPE.finditer(line):
            parts.extend((line[k], k, k + 1) for k in range(at, m.start()))
            parts.extend((c, *m.span()) for c in _character(m[0]))
            at = m.end()
        parts.extend((line[k], k, k + 1) for k in range(at, len(line)))
        return _plain(parts)
    for k, c in enumerate(line):
        parts.append((c, k, k + 1))
        while (n := _escaped(parts)) is not None:
            a, b = parts[-n][1], parts[-1][2]
            new = _character("".join(p[0] for p in parts[-n:]))
            del parts[-n:]
            parts.extend((x, a, b) for x in new)
    return _plain(parts)


def _escaped(parts: list[tuple[str, int, int]]) -> int | None:
    """The length of the escape that the last characters are."""
    last = parts[-1][0]
    for n in range(4, LONGEST_ESCAPE + 1) if last in "};" else (4, 6, 10) if last in "0123456789abcdefABCDEF" else ():
        if len(parts) >= n and parts[-n][0] in "\\&":
            escape = "".join(p[0] for p in parts[-n:])
            if ESCAPE.fullmatch(escape) and _character(escape) != escape:
                return n
    return None


def _lines(text: str, pattern: re.Pattern) -> Iterator[tuple[int, str]]:
    """(start, line) of the lines in which the pattern matches."""
    at = 0
    while m := pattern.search(text, at):
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        start = text.rfind("\n", 0, m.start()) + 1
        yield start, text[start:end]
        at = end


def _broken(regions: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """The regions that aren't whole, as one where they overlap, but for those that overlap a whole one: there the same characters
    are read in several ways, as the lines of a wrapped block are by themselves and together."""
    whole = sorted((a, b) for a, b, ok in regions if ok)
    reach = list(accumulate((b for _, b in whole), max))
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for a, b, ok in regions if not ok):
        k = bisect_left(whole, (b,))
        if k and reach[k - 1] > a:
            continue
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def unwrap(layer: Layer, outer: list[tuple[int, int, bool]], inner: list[tuple[int, int, bool]]) -> Iterator[Layer]:
    """The layers below, one by one: of each line with escapes that of one step and that of all steps, and those of each base64 region.

    Compressed regions are noted by their place in the text, with whether they are whole: in ``outer``, or in ``inner`` the broken
    ones under a base64 region, where the place doesn't tell which overlap.
    """
    text = layer.text
    for mark, pattern, decode in (("%", PERCENT, _unpercent), ("\\", ESCAPE, _unescape)):
        if layer.stepped == mark or (mark == "%" and "%" not in text) or (mark != "%" and "\\" not in text and "&" not in text):
            continue
        for start, line in _lines(text, pattern):
            for whole in (False, True):
                decoded, places = decode(line, whole)
                yield Layer(decoded, *layer.span(start, start + len(line)), [layer.span(start + a, start + b) for a, b in places], mark, layer.inner)
                if not pattern.search(decoded):
                    break
    regions = []
    for run, a, b in _runs(text):
        ends: list[bool] = []
        for decoded in _unbase64(run, ends):
            yield Layer(decoded, *layer.span(a, b), inner=True)
        if ends:
            regions.append((a, b, all(ends)))
    if layer.inner:
        inner.extend((*layer.span(a, b), False) for a, b in _broken(regions))
    else:
        outer.extend((*layer.span(a, b), ok) for a, b, ok in regions)


def _runs(text: str) -> Iterator[tuple[str, int, int]]:
    """(run, start, end) of what may be base64, in a line or over lines."""
    for m in BASE64.finditer(text):
        yield m[0], *m.span()
    if "\n" in text:
        yield from _wrapped(text)


def find(text: str | None) -> Found:
    """All spans of a text: the base ones, and those of its layers mapped to it."""
    text = text or ""
    order = {k: i for i, k in enumerate(KINDS)}
    rank = lambda s: (s[1], order[s[0]], s[2])
    base = sorted(scan(text), key=rank)
    more: set[tuple[str, int, int]] = set()
    outer: list[tuple[int, int, bool]] = []
    inner: list[tuple[int, int, bool]] = []
    todo = [unwrap(Layer(text, 0, len(text), _Same()), outer, inner)]  # what is still to come of each layer on the way down
    seen: set[tuple[int, int, bytes]] = set()
    n = 0
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        mark = (layer.start, layer.end, hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if mark in seen:
            continue
        seen.add(mark)
        n += 1
        for kind, a, b in scan(layer.text):
            more.add((kind, *layer.span(a, b)))
        todo.append(unwrap(layer, outer, inner))
    broken = _broken([*((a, b, False) for a, b in _broken(outer)), *inner])
    return Found(base, sorted(more.union(base), key=rank), n, broken)


class _Same:
    """Places of the text itself: every character is where it is."""

    def __getitem__(self, k: int) -> tuple[int, int]:
        return k, k + 1


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find(t) for t in texts_in(batch)]
        count = lambda kind: [sum(s[0] == kind for s in f.base) for f in found]  # noqa: E731,B023
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_assign": count("assign"),
                "n_access": count("access"),
                "n_hex": count("hex"),
                "base_sha256": [hashlib.sha256(joined(f.base).encode()).hexdigest() for f in found],
                "spans": [joined(f.spans) for f in found],
                "n_layers": [f.layers for f in found],
                "broken": [",".join(f"{a}:{b}" for a, b in f.broken) for f in found],
            }
        )


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers (distinct layers unwrapped), broken (start:end of encoded
    regions whose compressed data doesn't decode to its end, comma-joined)."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, broken string"
    return docs.select("doc_id", "text").mapInArrow(_scan_batches, schema)
