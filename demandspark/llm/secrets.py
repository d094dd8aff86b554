"""Secret scan with a worklist of decoded layers.

Three kinds of secret are matched in the text itself. Then layers are unwrapped until nothing
new appears: percent escapes, Unicode escapes and character references give the whole layer
anew; base64 runs (also wrapped over lines) whose bytes are text, or text compressed with zlib,
gzip, bzip2 or xz, give a layer of their own. Every layer keeps for each of its characters the
stretch of the original text it came from, so a secret found at any depth is reported by its
place there. A layer whose text came from the same stretch before is not taken up again.

A base64 run that is no text as a whole may have other text glued to it or stand on several lines.
All places where it could start fall in one of four alignments, so it is decoded four times,
whatever its length, and each of these texts is a layer (bytes stand for themselves) in which
every character keeps its own four characters as its place. Compressed streams are looked for after
each '/', '_', '-' and line end. Work is linear in a run's length. Percent signs that are escaped
over and over are peeled in one step.

Rows are independent. Null is an empty text. A compressed layer is read whole, in overlapping
pieces of ``MAX_LAYER_BYTES`` decoded bytes, which bounds memory; the row's own text is never cut. Spans are in code points, end exclusive, and named once each.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
MAX_LAYER_BYTES = 64 << 20
#: Pieces of inflated data share so many bytes.
OVERLAP = 1 << 20

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ASSIGNED = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPES = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&\#([0-9]{1,7});|&\#[xX]([0-9A-Fa-f]{1,6});"
)
_PEEL = re.compile(r"%25(?:25)+")
#: The shortest secret has 14 characters, so shorter runs hold none.
_BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]+={0,2}|[A-Za-z0-9+/_-]{18,}={0,2}")
_GLUE = re.compile(r"[/_-]")
_CONTROL = re.compile(r"[\x00-\x08\x0E-\x1F\x7F]")


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


class Layer(NamedTuple):
    """Text, and for each character where its source starts and ends in the row's text."""

    text: str
    starts: list[int] | range
    ends: list[int] | range


def scan(text: str) -> list[Span]:
    """Secrets of all kinds that stand in ``text`` as it is."""
    lower, found = text.lower(), []
    # Most texts have none of the words, which is found much faster without the expression.
    if any(word in lower for word in _ASSIGNED):
        found = [Span(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    # A run is as long as can be, so asking for the length is asking for it afterwards.
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [Span(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _rebuilt(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match replaced by decode(match): (character, first, last) pieces."""
    text, starts, ends, at, changed = [], [], [], 0, False
    for m in pattern.finditer(layer.text):
        pieces = decode(m)
        if pieces is None:
            continue
        changed = True
        text.append(layer.text[at : m.start()])
        starts.extend(layer.starts[at : m.start()])
        ends.extend(layer.ends[at : m.start()])
        for char, first, last in pieces:
            text.append(char)
            starts.append(layer.starts[first])
            ends.append(layer.ends[last - 1])
        at = m.end()
    if not changed:
        return None
    text.append(layer.text[at:])
    starts.extend(layer.starts[at:])
    ends.extend(layer.ends[at:])
    return Layer("".join(text), starts, ends)


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    out, at = [], m.start()
    for char in bytes.fromhex(m[0].replace("%", "")).decode(errors="surrogateescape"):
        # A byte that is no text stands for itself.
        odd = 0xDC80 <= ord(char) < 0xDD00
        width = 3 if odd else 3 * len(char.encode())
        out.append(("\ufffd" if odd else char, at, at + width))
        at += width
    return out


def _escape(m: re.Match) -> list[tuple[str, int, int]] | None:
    code = next(((g, 10 if i == 4 else 16) for i, g in enumerate(m.groups(), 1) if g), None)
    if code is not None:
        number = int(*code)
        if number > 0x10FFFF or 0xD800 <= number < 0xE000:
            return None
        return [(chr(number), m.start(), m.end())]
    out, at = [], m.start()
    units = [int(x, 16) for x in m[0].split("\\u")[1:]]
    while units:
        two = len(units) > 1 and 0xD800 <= units[0] < 0xDC00 <= units[1] < 0xE000
        n = 2 if two else 1
        char = chr(0x10000 + ((units[0] - 0xD800) << 10) + units[1] - 0xDC00) if two else "\ufffd" if 0xD800 <= units[0] < 0xE000 else chr(units[0])
        out.append((char, at, at + 6 * n))
        at, units = at + 6 * n, units[n:]
    return out


def _decompressor(raw: bytes | memoryview):
    """A new decompressor for what ``raw`` starts with; None if that is no compressed stream."""
    if raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and raw[1:2] in (b"\x01", b"\x5e", b"\x9c", b"\xda") and len(raw) > 2):
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _inflated(raw: bytes | memoryview) -> Iterator[bytes]:
    """The content of all members of a compressed stream, in pieces of ``MAX_LAYER_BYTES`` that
    overlap by ``OVERLAP``; what stands before damage is read. Nothing if it is no stream."""
    piece = b""
    while (stream := _decompressor(raw)) is not None:
        data = raw
        try:
            while not stream.eof:
                got = stream.decompress(data, max(1, MAX_LAYER_BYTES - len(piece)))
                data = stream.unconsumed_tail if hasattr(stream, "unconsumed_tail") else b""
                piece += got
                if len(piece) >= MAX_LAYER_BYTES:
                    yield piece
                    piece = piece[-OVERLAP:]
                elif not got and not data:
                    break
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            break
        rest = stream.unused_data if stream.eof else b""
        if len(rest) >= len(raw):
            break
        raw = rest
    if piece:
        yield piece


def _texts(raw: bytes) -> Iterator[tuple[str, bool]]:
    """Bytes as text, unwrapped from compression as often as needed, and whether all of it is
    UTF-8 without controls. Bytes that are no text are replaced."""
    if _decompressor(raw) is not None:
        some = False
        for piece in _inflated(raw):
            some = True
            for text, _ in _texts(piece):
                yield text, True
        if some:
            return
    text = raw.decode(errors="replace")
    if text:
        yield text, "\ufffd" not in text and not _CONTROL.search(text)


def _decoded(run: str) -> bytes:
    """A base64 run without its line ends; a last character that is no byte is left out."""
    run = re.sub(r"[\r\n=]", "", run).translate(_URL_SAFE)
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _leads_on(text: str) -> bool:
    """Whether a layer can give any span, itself or by what is encoded in it."""
    escaped = ("%" in text and _PERCENT.search(text)) or (("\\" in text or "&#" in text) and _ESCAPES.search(text))
    return bool(escaped or scan(text) or _BASE64.search(text))


def _stretch(layer: Layer, text: str, first: int, last: int) -> Layer:
    """A layer whose characters all come from one stretch."""
    return Layer(text, [layer.starts[first]] * len(text), [layer.ends[last - 1]] * len(text))


def _whole(run: str) -> list[str] | None:
    """The texts of a run that is nothing but base64 of text or of a stream of text."""
    raw = _decoded(run)
    if len(run) - sum(run.count(c) for c in "\r\n=") - 4 * (len(raw) // 3) == 1:
        return None
    texts = [*_texts(raw)]
    return [text for text, _ in texts] if texts and all(clean for _, clean in texts) else None


def _base64(layer: Layer) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        first, last = m.span()
        texts = _whole(m[0])
        if texts is None and "\n" in m[0]:
            # The block without its last line, which is a run of its own.
            cut = m[0].rindex("\n") + 1
            texts = _whole(m[0][:cut])
            if texts is not None:
                yield from (_stretch(layer, text, first, first + cut) for text in texts)
                if last - first - cut >= 18:
                    rest = _whole(m[0][cut:])
                    yield from _aligned(layer, first + cut, last) if rest is None else (_stretch(layer, text, first + cut, last) for text in rest)
                continue
        yield from _aligned(layer, first, last) if texts is None else (_stretch(layer, text, first, last) for text in texts)


def _aligned(layer: Layer, first: int, last: int) -> Iterator[Layer]:
    """Layers of a run that isn't base64 as a whole: its four alignments, and streams inside."""
    run = layer.text[first:last]
    at = [first + m.start() for m in re.finditer(r"[^\r\n=]", run)] if "\n" in run else range(first, first + len(run.rstrip("=")))
    chars = re.sub(r"[\r\n=]", "", run)
    starts = {0, 1, 2, 3, *(m.end() for m in _GLUE.finditer(chars))}
    if "\n" in run:
        starts.update(i for i in range(1, len(at)) if at[i] > at[i - 1] + 1)
    for k in range(4):
        raw = _decoded(chars[k:])
        text = raw.decode("latin-1")
        if _leads_on(text):
            groups = [(layer.starts[at[i]], layer.ends[at[min(i + 3, len(at) - 1)]]) for i in range(k, len(at), 4)]
            yield Layer(text, [groups[i // 3][0] for i in range(len(text))], [groups[i // 3][1] for i in range(len(text))])
        view = memoryview(raw)
        for start in starts:
            if start % 4 == k and start < len(at) and _decompressor(view[3 * (start // 4) :][:6]) is not None:
                for piece in _inflated(view[3 * (start // 4) :]):
                    yield from (_stretch(layer, found, at[start], last) for found, _ in _texts(piece) if _leads_on(found))


_URL_SAFE = str.maketrans("-_", "+/")


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(in the text itself, with those of all layers below it)."""
    text = text or ""
    base = scan(text)
    found = set(base)
    todo = [Layer(text, range(len(text)), range(1, len(text) + 1))]
    seen: set[tuple] = {(text, 0, len(text))}
    while todo:
        layer = todo.pop()
        below = [*_base64(layer)]
        if "%2525" in layer.text:
            below.append(_rebuilt(layer, _PEEL, lambda m: [("%", m.start(), m.end() - 2), ("2", m.end() - 2, m.end() - 1), ("5", m.end() - 1, m.end())]))
        elif "%" in layer.text:
            below.append(_rebuilt(layer, _PERCENT, _percent))
        if "\\" in layer.text or "&#" in layer.text:
            below.append(_rebuilt(layer, _ESCAPES, _escape))
        for new in below:
            if new is None or not new.text or (key := (new.text, new.starts[0], new.ends[-1])) in seen:
                continue
            seen.add(key)
            found.update(Span(new.starts[s.start], s.kind, new.ends[s.end - 1]) for s in scan(new.text))
            todo.append(new)
    return base, sorted(found)


def _joined(found: list[Span]) -> str:
    return ",".join(map(str, found))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [spans(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s.kind == k for s in base) for base, _ in both], pa.int64()) for k in range(3)]
            hashes = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(hashes, pa.string()), pa.array([_joined(a) for _, a in both], pa.string())],
                [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(
        each, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
