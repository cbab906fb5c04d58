"""Secret scans with a recursive decoding worklist.

A text is scanned, its encoded stretches (URL escapes, Unicode escapes, base64 in one line or broken into lines) are
unwrapped, and what comes out is scanned and unwrapped in turn, at every place where it stands, until nothing is left
to unwrap. The escapes of a run are unwrapped together and to their end, escapes that other escapes make included; base64
is read from each of its first four characters. A layer that was entered at its place before, in whatever way, is not
entered again. Spans of inner layers are mapped, character by character, to the stretch of the text they come from.

A layer whose bytes are gzip, zlib or zstandard data is unpacked as a stream, with all its members or frames, and
scanned window by window, whatever its size; what it holds, however deep, is mapped to its whole stretch. What packed
data hold is worked out once for a text. Data that only begin like packed ones are text. Nothing here calls itself, so
that no depth of layers exhausts the stack.
"""

from __future__ import annotations

import base64
import codecs
import contextlib
import hashlib
import re
import tempfile
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import IO

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tessera.llm.shared import map_texts, spans_digest

#: The kinds in their order and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Whether a text can hold an assignment at all: a cheap test before the pattern.
HINTS = ("passw", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"\S+")
ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
#: Base64 in one line: 22 characters hold the shortest secret. Broken into lines: all but the last of 22 or more.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{22,}+={0,2}")
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{22,}+(?:\r?\n[A-Za-z0-9+/_-]{22,}+)*+(?:\r?\n[A-Za-z0-9+/_-]++)?={0,2}")
BREAK = re.compile(r"\r?\n")
STANDARD = str.maketrans("-_", "+/")
#: First bytes of zstandard, gzip and zlib data.
PACKED = (b"\x28\xb5\x2f\xfd", b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
#: Bytes that are unpacked at a time; bytes of a layer that are held in memory, where more go to a file.
CHUNK, HELD = 1 << 20, 8 << 20
#: Where a window may end: no match and no encoded stretch goes across a blank between two letters or digits, or
#: across a line's end before a line that is not all base64.
CALM = re.compile(r"(?<=[0-9A-Za-z])\x20(?=[0-9A-Za-z])|\n(?=[A-Za-z0-9+/=_\r-]*+[^A-Za-z0-9+/=_\r\n-])")

Span = tuple[str, int, int]


def base_spans(text: str, lower: str | None = None) -> list[Span]:
    """The spans of the three base patterns, by start and kind. ``lower``: the text in lower case, if at hand."""
    lower = text.lower() if lower is None else lower
    found: list[Span] = []
    if any(h in lower for h in HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: An inner layer: its text, and for each character where the stretch it comes from begins and ends.
Layer = tuple[str, np.ndarray, np.ndarray]


def _as_text(data: bytes) -> tuple[str, np.ndarray]:
    """The bytes as UTF-8, or else a character a byte; and where each character's bytes end."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1"), np.arange(1, len(data) + 1)
    heads = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)
    return text, np.append(heads[1:], len(data))[: len(text)]


_HEX = frozenset("0123456789abcdefABCDEF")


def _unescaped(run: str, at: int) -> Layer | None:
    """A run with all its escapes unwrapped to their end; None if it has none.

    Characters are taken one by one; where the last ones make an escape, they become its character, which may in turn be
    the last of another escape. URL bytes beyond ASCII wait for their neighbours, of which they make UTF-8 characters.
    """
    out: list[str | int] = []
    starts: list[int] = []
    ends: list[int] = []
    changed = False
    for k, c in enumerate(run, at):
        out.append(c)
        starts.append(k)
        ends.append(k + 1)
        while out[-1] in _HEX:
            if len(out) > 2 and out[-3] == "%" and out[-2] in _HEX:
                n = 3
            elif len(out) > 3 and out[-4] == "\\" and out[-3] == "x" and out[-2] in _HEX:
                n = 4
            elif len(out) > 5 and out[-6] == "\\" and out[-5] == "u" and out[-2] in _HEX and out[-3] in _HEX and out[-4] in _HEX:
                n = 6
            else:
                break
            value = int("".join(out[1 - n if n == 3 else 2 - n :]), 16)
            end, changed = ends[-1], True
            del out[1 - n :], ends[1 - n :], starts[1 - n :]
            ends[-1] = end
            out[-1] = value if n == 3 and value > 127 else chr(value)
    if not changed:
        return None
    parts: list[str] = []
    first: list[int] = []
    last: list[int] = []
    k = 0
    while k < len(out):
        c = out[k]
        if isinstance(c, int):
            j = k
            while j < len(out) and isinstance(out[j], int):
                j += 1
            text, upto = _as_text(bytes(out[k:j]))
            upto = upto.tolist()
            parts.append(text)
            first += [starts[k + x] for x in [0, *upto[:-1]]]
            last += [ends[k + x - 1] for x in upto]
            k = j
            continue
        if "\ud800" <= c < "\udc00" and k + 1 < len(out) and isinstance(out[k + 1], str) and "\udc00" <= out[k + 1] <= "\udfff":
            parts.append((c + out[k + 1]).encode("utf-16-le", "surrogatepass").decode("utf-16-le"))
            first.append(starts[k])
            last.append(ends[k + 1])
            k += 2
            continue
        parts.append("\ufffd" if "\ud800" <= c <= "\udfff" else c)
        first.append(starts[k])
        last.append(ends[k])
        k += 1
    return "".join(parts), np.array(first, np.int64), np.array(last, np.int64)


def _packed_in(run: str, layer: Layer) -> bytes | None:
    """The packed data that a run of escapes holds: unwrapped level by level, as data may hold what looks like an escape."""
    if not layer[0].encode("latin-1", "replace").startswith(PACKED) and not _bytes_of(run[:64]).startswith(PACKED):
        return None
    while run:
        further = ESCAPE.sub(lambda m: chr(int(m[1] or m[2] or m[3], 16)), run)
        if further == run:
            return None
        run = further
        if (data := run.encode("latin-1", "replace")).startswith(PACKED):
            return data
    return None


def _bytes_of(run: str) -> bytes:
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2] or m[3], 16)), run).encode("latin-1", "replace")


def _base64_bytes(body: str) -> bytes:
    body = body[: len(body) - (len(body) % 4 == 1)].translate(STANDARD)
    return base64.b64decode(body + "=" * (-len(body) % 4))


def unwrapped(content: str) -> Iterator[tuple[int, int, bytes | None, Layer]]:
    """The encoded stretches of a text: start, end, what may be packed data, and the layer that they hold as text."""
    if ("%" in content or "\\" in content) and ESCAPE.search(content):
        for m in RUN.finditer(content):
            if ("%" in m[0] or "\\" in m[0]) and (layer := _unescaped(m[0], m.start())):
                yield m.start(), m.end(), _packed_in(m[0], layer), layer
    for m in BASE64.finditer(content):
        yield from _from_base64(m[0], m.start(), np.arange(len(m[0])))
    if "\n" in content:
        for m in LINES.finditer(content):
            if "\n" in m[0]:
                places = np.flatnonzero(~np.isin(np.array([m[0]]).view(np.uint32), (10, 13)))
                yield from _from_base64(BREAK.sub("", m[0]), m.start(), places)


def _from_base64(whole: str, at: int, places: np.ndarray) -> Iterator[tuple[int, int, bytes | None, Layer]]:
    """What base64 characters hold if they begin at one of the first four; ``places`` are theirs after ``at``."""
    whole = whole.rstrip("=")
    end = at + int(places[-1]) + 1
    for first in range(min(4, max(1, len(whole) - 21))):
        body, own = whole[first:], places[first:]
        data = _base64_bytes(body)
        text, ends = _as_text(data)
        starts = np.append(0, ends[:-1])[: len(ends)]
        layer = text, at + own[starts * 4 // 3], at + own[np.minimum(len(body) - 1, (ends * 4 + 2) // 3 - 1)] + 1
        yield at + int(own[0]), end, data if data.startswith(PACKED) else None, layer


class Unpacked:
    """The unpacked bytes of all members or frames of a stream, in pieces; ``clean`` says whether all of it was packed data."""

    def __init__(self, chunks: Iterator[bytes]):
        self.clean, self.pieces = False, self._read(chunks)

    def __iter__(self) -> Iterator[bytes]:
        return self.pieces

    def _read(self, chunks: Iterator[bytes]) -> Iterator[bytes]:
        held = next(chunks, b"")
        if held.startswith(PACKED[0]):
            with contextlib.suppress(zstandard.ZstdError):
                reader = zstandard.ZstdDecompressor().stream_reader(_Chunks(chain([held], chunks)), read_across_frames=True)
                while out := reader.read(CHUNK):
                    yield out
                self.clean = True
            return
        while held:
            member = zlib.decompressobj(47)
            try:
                while not member.eof and held:
                    out = member.decompress(held, CHUNK)
                    held = member.unconsumed_tail or (member.unused_data if member.eof else next(chunks, b""))
                    if out:
                        yield out
                if out := member.flush():
                    yield out
            except zlib.error:
                return
            held = held or next(chunks, b"")
            self.clean = member.eof and not held


class _Chunks:
    """A reader over an iterator of bytes."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def read(self, n: int = -1) -> bytes:
        while n < 0 or len(self.held) < n:
            more = next(self.chunks, None)
            if more is None:
                break
            self.held += more
        out, self.held = (self.held, b"") if n < 0 else (self.held[:n], self.held[n:])
        return out


def _windows(chunks: Iterator[bytes]) -> Iterator[str]:
    """A stream's text in windows that break no match and no encoded stretch, of whatever length."""
    decoder, held, seen = codecs.getincrementaldecoder("utf-8")("replace"), "", 0
    for chunk in chunks:
        held += decoder.decode(chunk)
        cut, begin, reach = 0, len(held), 1 << 12
        while not cut and begin > seen:
            begin = max(seen, len(held) - reach)
            cut = max((m.end() for m in CALM.finditer(held, begin)), default=0)
            reach *= 16
        if cut:
            yield held[:cut]
            held = held[cut:]
        # of what is not calm only the last line's end and the last character may become so
        seen = max(0, min(held.rfind("\n") if "\n" in held else len(held), len(held) - 1))
    yield held + decoder.decode(b"", True)


def _pieces(file: IO[bytes]) -> Iterator[bytes]:
    """A file from its beginning, in pieces."""
    file.seek(0)
    while piece := file.read(CHUNK):
        yield piece


class Packed:
    """What kinds of secrets packed data hold, worked out once for a text."""

    def __init__(self) -> None:
        self.known: dict[bytes, frozenset[str]] = {}
        self.clean: dict[bytes, bool] = {}

    def kinds(self, data: bytes) -> frozenset[str]:
        """The kinds in all that packed data hold, however deep; data that are not packed are left to the caller."""
        mark = hashlib.sha256(data).digest()
        if mark not in self.known:
            self.known[mark] = self._found(data, mark)
        return self.known[mark]

    def whole(self, data: bytes) -> bool:
        """Whether these are packed data to their end."""
        mark = hashlib.sha256(data).digest()
        if mark not in self.clean:
            stream = Unpacked(iter([data]))
            for _ in stream:
                pass
            self.clean[mark] = stream.clean
        return self.clean[mark]

    def _found(self, data: bytes, mark: bytes) -> frozenset[str]:
        found: set[str] = set()
        entered = {mark}
        work = [self._texts(data, entered)]
        while work and len(found) < len(KINDS):
            text = next(work[-1], None)
            if text is None:
                work.pop()
                continue
            own = hashlib.sha256(text.encode("utf-8", "replace")).digest()
            if own in entered:
                continue
            entered.add(own)
            found.update(kind for kind, _, _ in base_spans(text))
            for _, _, inner, layer in unwrapped(text):
                if inner is not None and (own := hashlib.sha256(inner).digest()) not in entered:
                    entered.add(own)
                    if own in self.known:
                        found |= self.known[own]
                    else:
                        work.append(self._texts(inner, entered))
                if inner is None or not self.whole(inner):
                    work.append(iter([layer[0]]))
        return frozenset(found)

    def _texts(self, data: bytes, entered: set[bytes]) -> Iterator[str]:
        """Windows of what data hold; data packed in data are unpacked in turn, and such as do not end well are text too.

        A layer is unpacked into a file, which is in memory while it is small, so that the way is one for all sizes.
        """
        with contextlib.ExitStack() as files:
            below, layer = iter([data]), None
            while True:
                stream, mark = Unpacked(below), hashlib.sha256()
                held = files.enter_context(tempfile.SpooledTemporaryFile(HELD))
                for piece in stream:
                    mark.update(piece)
                    held.write(piece)
                if layer is not None:
                    if not stream.clean:
                        layer.seek(0)
                        yield _as_text(layer.read())[0]
                    layer.close()
                held.seek(0)
                if not held.read(4).startswith(PACKED):
                    yield from _windows(_pieces(held))
                    return
                if mark.digest() in entered:
                    return
                entered.add(mark.digest())
                below, layer = _pieces(held), held


def secrets_of(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those of inner layers."""
    base = base_spans(text)
    every, packed = set(base), Packed()
    entered: set[tuple[bytes, int, int]] = set()
    work: list[tuple[str, np.ndarray | None, np.ndarray | None]] = [(text, None, None)]
    while work:
        content, starts, ends = work.pop()
        for a, b, data, layer in unwrapped(content):
            if data is not None:
                every |= {(kind, a if starts is None else int(starts[a]), b if ends is None else int(ends[b - 1])) for kind in packed.kinds(data)}
                if packed.whole(data):
                    continue
            inner, s, e = layer
            if not inner:
                continue
            if starts is not None and ends is not None:
                s, e = starts[s], ends[e - 1]
            mark = hashlib.blake2b(inner.encode("utf-8", "replace"), digest_size=16).digest(), int(s[0]), int(e[-1])
            if mark not in entered:
                entered.add(mark)
                every |= {(kind, int(s[x]), int(e[y - 1])) for kind, x, y in base_spans(inner)}
                work.append((inner, s, e))
    return base, sorted(every, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def secret_scan(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text.

    Returns doc_id, n_assign, n_access, n_hex (counts of base spans), base_sha256, spans (all spans as
    kind:start:end by start, then kind; code points, end exclusive) and n_decoded (spans that only inner layers
    show). A null or empty text has no spans. Repeated rows each give a row; other columns are not carried. One
    pass without a shuffle; a text is handled by itself in one task.
    """

    def per_batch(_: pa.RecordBatch, texts: list[str]) -> dict:
        found = [secrets_of(t) for t in texts]
        return {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in KINDS} | {
            "base_sha256": [hashlib.sha256(spans_digest(base).encode()).hexdigest() for base, _ in found],
            "spans": [spans_digest(every) for _, every in found],
            "n_decoded": [len(every) - len(base) for base, every in found],
        }

    return map_texts(docs, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long", per_batch)


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Replace each secret (joined with those that overlap it) by ``mark``; rows and columns stay, n_chars follows."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(at).to_pylist():
                pieces, k, end = [], 0, 0
                for _, s, e in secrets_of(text)[1] if text else []:
                    if s >= end:
                        pieces += [text[k:s], mark]
                    k = end = max(end, e)
                out.append(text if not pieces else "".join(pieces) + text[k:])
            batch = batch.set_column(at, batch.schema.field(at), pa.array(out, pa.string()))
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                batch = batch.set_column(n, batch.schema.field(n), pa.array([None if t is None else len(t) for t in out], batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
