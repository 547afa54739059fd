"""Secret scans through nested encodings.

A worklist starts with the text. A layer that is taken off the list is scanned; what it decodes to goes onto the list
(the last first) as layers of their own, with a map from their characters back to the text's: the whole layer with its escapes undone
(percent, Unicode), and every run that decodes (base64 with or without compression, hex of text). Layers seen
before, by place and content, are not taken again, so the list runs empty: a fixpoint. Compressed layers (zlib, gzip with
its members, bare deflate) unfold to the end, whatever is compressed inside them too.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.llm.common import documents

KINDS = ("assign", "access", "hex")
# The kinds' patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_CHARS = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_CHARS = 20
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of [0-9a-f]+ of 24 characters or more

#: Bytes of a compressed layer that are held at once: a longer one is read to its end in pieces. A piece begins with the
#: end of the one before: the encoded run that goes on there, up to half a piece, and OVERLAP bytes before it.
UNFOLDED, OVERLAP = 1 << 24, 1 << 16

_ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]{1,6}\}|\\x[0-9a-fA-F]{2}")
_BEHIND = {"%": re.compile(r"[0-9A-Fa-f]{2}"), "\\": re.compile(r"u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]{1,6}\}|x[0-9a-fA-F]{2}")}
_LEADS = {ord(x) for x in _BEHIND}
_TOKEN = re.compile(r"\S+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_HEXTEXT = re.compile(r"[0-9a-fA-F]{32,}")
_BREAK = re.compile(r"(?<=[A-Za-z0-9+/_-])\r?\n[\x20\t]*(?=[A-Za-z0-9+/_-])")
#: Bytes without so many characters of ASCII in a row hold no secret, encoded or not: the shortest is token=abcdef.
_TEXTUAL = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1a\x7f-\x9f]")
_RUN_BACKWARDS = re.compile(rb"(?:[A-Za-z0-9+/_=%\\{}\r-]|[\x20\t]*\n)*+")
#: The first two bytes of zlib data, or three of gzip data.
_HEADER = re.compile(b"\x1f\x8b\x08|" + b"|".join(re.escape(bytes([a, b])) for a in range(8, 0x80, 16) for b in range(256) if (a << 8 | b) % 31 == 0 and not b & 32), re.S)

Span = tuple[int, int, str]


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping for each kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


#: Bytes of a layer from a place on, in chunks; it can be read again.
Bytes = Callable[[int], Iterator[bytes]]
_ZLIB, _RAW = 47, -15  # window bits of zlib or gzip data, told by its header, and of deflate data without one


def _chunks(data: bytes) -> Bytes:
    """1024 compressed bytes unfold to about 1 MiB at most."""
    return lambda at: (data[i : i + 1024] for i in range(at, len(data), 1024))


def _inflated(read: Bytes, at: int, bits: int) -> Iterator[tuple[bytes, int, bool]]:
    """What compressed data at a place unfolds to, with the members that follow it and what can be read of one that is
    damaged or ends early: bytes, the place reached, and whether a member ends there."""
    reader, held = zlib.decompressobj(bits), b""
    for some in read(at):
        held += some
        while held:
            if reader.eof:  # does another member follow?
                if bits != _ZLIB or len(held) >= 3 and not _HEADER.match(held):
                    return
                if len(held) < 3:
                    break
                reader = zlib.decompressobj(bits)
            before = reader.copy()
            try:
                out = reader.decompress(held)
            except zlib.error:
                with contextlib.suppress(zlib.error):
                    for i in range(len(held)):
                        yield before.decompress(held[i : i + 1]), at + i + 1, False
                return
            at += len(held) - len(reader.unused_data)
            held = reader.unused_data
            yield out, at, reader.eof


def _likely(head: bytes) -> bool:
    """Whether what an unfinished member began with is text or compressed, not what any bytes unfold to."""
    text = head.decode("utf-8", "ignore")
    return bool(_HEADER.match(head)) or len(text.encode()) > len(head) - 4 and len(set(text)) > 3 and not _CONTROL.search(text)


def _bare(data: bytes) -> bool:
    """Whether data may begin with deflate data without a header."""
    if _HEADER.match(data) or data[:1] and data[0] & 6 == 6:
        return False
    with contextlib.suppress(zlib.error):
        reader = zlib.decompressobj(_RAW)
        head = reader.decompress(data[:1024], 256)
        return reader.eof or _likely(head)
    return False


def _windows(read: Bytes, at: int, bits: int) -> Iterator[tuple[bytes, int, int, bool, bool, Bytes]]:
    """_inflated() in overlapping windows: the window, its place in what unfolds, the place reached, whether a member ends
    there, whether the window is the last, and all that unfolds, to be read again."""

    def unfolded(skip: int) -> Iterator[bytes]:
        for out, *_ in _inflated(read, at, bits):
            if skip < len(out):
                yield from _chunks(out)(skip)
            skip = max(0, skip - len(out))

    held, place, new, reached, whole = bytearray(), 0, 0, at, False
    for out, reached_, whole_ in _inflated(read, at, bits):
        if len(held) >= UNFOLDED and out:
            yield bytes(held), place, reached, whole, False, unfolded
            run = _RUN_BACKWARDS.match(held[: -UNFOLDED // 2 : -1]).end()
            gone = len(held) - (OVERLAP + (run if run < UNFOLDED // 2 - 1 else 0))
            del held[:gone]
            place, new = place + gone, 0
        held += out
        new, reached, whole = new + len(out), reached_, whole_
    if whole or place or new and _likely(bytes(held[:256])):
        yield bytes(held), place, reached, whole, True, unfolded


def _inside(window: bytes, place: int, last: bool, layer: Bytes, tried: int) -> Iterator[tuple]:
    """_windows() of the compressed data in a window of a layer, from the place `tried` on. Data that runs on beyond the
    window is read from the layer itself."""
    until = len(window) if last else len(window) - OVERLAP // 2
    if not place and _bare(window):
        yield from _windows(_chunks(window) if last else layer, 0, _RAW)
    at = tried - place
    while m := _HEADER.search(window, at, until):
        at, read, first = m.start() + 1, _chunks(window), m.start()
        if not last:
            reached, whole = 0, False
            for _, reached, whole in _inflated(read, first, _ZLIB):
                pass
            if reached == len(window) and not whole:
                read, first = layer, place + first
        for got in _windows(read, first, _ZLIB):
            yield got
            if got[3]:
                at = max(at, got[2] - (place if read is layer else 0))


def _unfold(data: bytes, at: int, bits: int) -> Iterator[tuple[bytes, int, bool]]:
    """What compressed data at a place unfolds to, and what is compressed in there in turn, to the end: windows, with the
    place reached in `data` and whether a member ends there. Bytes that came before are not taken again."""
    seen: set[bytes] = set()
    work, reached, whole, tried = [_windows(_chunks(data), at, bits)], at, False, [0]
    while work:
        if not (got := next(work[-1], None)):
            work.pop()
            tried.pop()
            continue
        window, place, to, ends, last, layer = got
        if len(work) == 1:
            reached, whole = to, ends
        key = hashlib.blake2b(window, digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        yield window, reached, whole and len(work) == 1
        work.append(_inside(window, place, last, layer, tried[-1] if place else 0))
        tried[-1] = place + len(window) - OVERLAP // 2
        tried.append(0)


def _rewritten(text: str, changes: list[tuple[int, int, str]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The text with each (start, end, by) replaced, in order, and where each of its characters starts and ends."""
    out, starts, ends, at = [], [], [], 0
    for start, end, by in [*changes, (len(text), len(text), "")]:
        out += [text[at:start], by]
        starts += [np.arange(at, start), np.full(len(by), start)]
        ends += [np.arange(at + 1, start + 1), np.full(len(by), end)]
        at = end
    return "".join(out), np.concatenate(starts), np.concatenate(ends)


def _unit(text: str, at: int) -> tuple[int, int, bool]:
    """What the escape at a place stands for: its code, where it ends and whether it is a byte. What is an escape's first
    character again goes on with the text behind it, so %252541 is undone at once."""
    lead, code, end = text[at], -1, at + 1
    while m := _BEHIND[lead].match(text, end):
        code, end, byte = int(m[0].strip("ux{}"), 16), m.end(), lead == "%"
        if code not in _LEADS:
            break
        lead = chr(code)
    return code, end, byte


def _unescape(text: str) -> tuple[str, np.ndarray, np.ndarray] | None:
    """Escapes undone, with where each character starts and ends. Percent escapes that follow each
    other are bytes of UTF-8; what is no UTF-8 stays."""
    changes, at = [], 0
    while m := _ESCAPED.search(text, at):
        at = m.start()
        code, end, byte = _unit(text, at)
        got = chr(code) if code < 0xD800 or 0xDFFF < code <= 0x10FFFF else None
        if byte and code >= 0x80:
            got, octets = None, bytearray([code])
            size = 2 if code < 0xE0 else 3 if code < 0xF0 else 4
            while len(octets) < size and text[end : end + 1] == "%" and _ESCAPED.match(text, end):
                code, after, byte = _unit(text, end)
                if not byte or code < 0x80:
                    break
                octets.append(code)
                end = after
            with contextlib.suppress(UnicodeDecodeError):
                got = octets.decode("utf-8")
        if got is None:
            at += 1
            continue
        changes.append((at, end, got))
        at = end
    return _rewritten(text, changes) if changes else None


def _runs(pattern: re.Pattern[str], text: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Runs that match, and those that do once breaks of lines inside them are taken out, with their characters' places."""
    for m in pattern.finditer(text):
        yield m[0], np.arange(m.start(), m.end()), np.arange(m.start() + 1, m.end() + 1)
    if "\n" in text and (breaks := [(m.start(), m.end(), "") for m in _BREAK.finditer(text)]):
        joined, starts, ends = _rewritten(text, breaks)
        for m in pattern.finditer(joined):
            if ends[m.end() - 1] - starts[m.start()] > len(m[0]):
                yield m[0], starts[m.start() : m.end()], ends[m.start() : m.end()]


def _text(data: bytes) -> str:
    """Bytes as text: all of them if they are UTF-8, else the stretches that may hold something, with a zero between."""
    if not _TEXTUAL.search(data):
        return ""
    with contextlib.suppress(UnicodeDecodeError):
        if b"\0" not in data:
            return data.decode("utf-8")
    return "\0".join(x.decode("ascii") for x in _TEXTUAL.findall(data)) + "\0"


def _from_bytes(data: bytes, starts: np.ndarray, ends: np.ndarray, per: tuple[int, int]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Decoded bytes as layers: byte k came from the group of per[0] characters that gives per[1] bytes. All of them
    are one layer, of which only stretches of ASCII are kept if it is no UTF-8; compressed data, wherever it starts, is another."""

    def last(byte: np.ndarray | int) -> np.ndarray | int:
        return ends[np.minimum(len(ends), (byte // per[1] + 1) * per[0]) - 1]

    if text := _text(data):
        if "\0" in text:  # stretches of ASCII
            at = np.concatenate([np.r_[np.arange(m.start(), m.end()), m.end()] for m in _TEXTUAL.finditer(data)])
            sizes = np.ones(len(at), dtype=np.int64)
        else:
            code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            sizes = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            at = np.cumsum(sizes) - sizes
        yield text, starts[np.minimum(len(starts) - 1, at // per[1] * per[0])], last(at + sizes - 1)
    raw, at = [(0, _RAW)] if _bare(data) else [], 0
    while raw or (m := _HEADER.search(data, at)):
        if raw:
            begin, bits = raw.pop()
        else:
            begin, bits, at = m.start(), _ZLIB, m.start() + 1
        first = starts[begin // per[1] * per[0]]
        for unfolded, reached, whole in _unfold(data, begin, bits):
            if text := _text(unfolded):
                end = ends[-1] if reached == len(data) else last(reached - 1)
                yield text, np.broadcast_to(first, len(text)), np.broadcast_to(end, len(text))
            if whole and bits == _ZLIB:
                at = max(at, reached)


def _layers(text: str) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The layers directly below, each with the places of its characters in `text`."""
    if "%" in text or "\\" in text:
        if whole := _unescape(text):  # a key, its separator and its value may be escaped one by one
            yield whole
            for m in _TOKEN.finditer(text):  # what stands before a token may take the place of its key
                if _ESCAPED.search(m[0]) and (got := _unescape(m[0])):
                    yield got[0], got[1] + m.start(), got[2] + m.start()
    for run, starts, ends in _runs(_BASE64, text):
        digits = run.rstrip("=").replace("-", "+").replace("_", "/")
        for skip in range(4):  # what stands before the data may be of its alphabet
            part = digits[skip:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            yield from _from_bytes(base64.b64decode(part + "=" * (-len(part) % 4)), starts[skip:], ends[skip:], (4, 3))
    for run, starts, ends in _runs(_HEXTEXT, text):
        for skip in range(2):
            part = run[skip : len(run) - (len(run) - skip) % 2]
            yield from _from_bytes(bytes.fromhex(part), starts[skip:], ends[skip : skip + len(part)], (2, 1))


def _below(layer: str, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The layers directly below a layer, with the places of their characters in the text."""
    for text, s, e in _layers(layer):
        if not starts.strides[0] or not s.strides[0]:  # from compressed data: one place for all characters
            yield text, np.broadcast_to(starts[s[0]], len(text)), np.broadcast_to(ends[e[-1] - 1], len(text))
        else:
            yield text, starts[s], ends[e - 1]


def secrets(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: those of the text itself and those of every layer below, as spans of the text."""
    order = {k: i for i, k in enumerate(KINDS)}
    base = sorted(scan(text), key=lambda s: (s[0], order[s[2]], s[1]))
    found, seen = set(base), set()
    work = [_layers(text)]  # layers are made as they are asked for: those that wait take no memory
    while work:
        if not (below := next(work[-1], None)):
            work.pop()
            continue
        layer, starts, ends = below
        key = (int(starts[0]), int(ends[-1]), hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if key in seen:
            continue
        seen.add(key)
        found.update((int(starts[a]), int(ends[b - 1]), kind) for a, b, kind in scan(layer))
        work.append(_below(layer, starts, ends))
    return base, sorted(found, key=lambda s: (s[0], order[s[2]], s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced."""
    out, at = [], 0
    reach = -1
    for start, end, _ in spans:
        if start >= reach:
            if reach >= 0:
                at = reach
            out += [text[max(at, 0) : start], mask]
        reach = max(reach, end)
    return "".join(out) + text[max(reach, 0) :]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "masked"]
    for batch in batches:
        rows = []
        for x in batch.column(1):
            text = x.as_py() or ""
            base, spans = secrets(text)
            kinds = [k for *_, k in base]
            rows.append((*(kinds.count(k) for k in KINDS), written(base), written(spans), masked(text, spans) if spans else x.as_py()))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)


def scanned(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_assign, n_access, n_hex (base matches),
    base_spans, spans (kind:start:end, code points, comma-joined) and masked (the text without its secrets).

    A null text is empty (and its masked text null); a null doc_id stays null; repeated rows repeat; other columns
    are ignored. Whole texts are read.
    """
    return documents(docs).mapInArrow(_scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, masked string")


def masked_text(text: Column) -> Column:
    """A text column without its secrets, those in nested encodings too; a null text stays null."""

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else masked(t, secrets(t)[1]) for t in texts], dtype=object)

    return mask(text)
