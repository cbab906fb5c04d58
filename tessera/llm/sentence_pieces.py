"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent pairs.

A text gets a blank in front and its blanks become a mark. Its characters are symbols; an agenda holds the adjacent
pairs that are pieces of the vocabulary, the best score first and of equal ones the leftmost. The best pair becomes one
symbol and its new neighbours enter the agenda, until it is empty; what is no piece then falls into its bytes.

No merge can cross a place whose two characters stand side by side in no piece, so a text is cut there; in natural text
these are the blanks before words. Each stretch is merged once and kept, and all stretches that a worker has newly
learnt from an Arrow batch are encoded by the sentencepiece library too and must agree.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tessera.llm.byte_bpe import Strings
from tessera.llm.shared import Learnt, gathered, slices_of

#: Fixed values of the sentencepiece model format: kinds of pieces, and the model type of merges.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
#: The mark that stands for a blank.
MARK = "▁"
#: Segments of up to so many characters are merged many at once; ranks are below NEVER, places in an array below LOW.
SHORT, NEVER, LOW = 64, 1 << 30, (1 << 32) - 1
#: Stretches whose ids a Python worker keeps; it starts anew when there are more. Only speed depends on it.
CACHE = 600_000
#: Texts that are encoded at a time, and about how many bytes of them.
SLICE, SLICE_BYTES = 4000, 4 << 20


def _fields(body: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbered fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = body[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(body):
        head = number()
        kind = head & 7
        if kind == 0:
            yield head >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield head >> 3, body[at : at + size]
        at += size


class Model:
    """A vocabulary of pieces with scores, as read from a sentencepiece model file.

    Raises ValueError for models whose results this operator would not match: other types than merges, a normaliser
    that changes characters, removes blanks or puts none in front, and vocabularies with user-defined or unused pieces or
    without a piece for each byte.
    """

    def __init__(self, body: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict[int, int | bytes] = {}
        normaliser: dict[int, int | bytes] = {}
        for field, value in _fields(body):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3) != MERGES or trainer.get(24) or trainer.get(34):
            raise ValueError("the model must be of the merge type, with blanks before words")
        if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("the normaliser must be the identity with a blank in front")
        if {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.unknown_text = trainer.get(44, " ⁇ ".encode())
        end = trainer.get(47, b"</s>").decode()
        self.end = next((k for k, p in enumerate(self.pieces) if p == end and self.kinds[k] == CONTROL), None)
        self.byte_ids = {int(p[1:-1], 16): k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)) if kind == BYTE}
        if len(self.byte_ids) != 256:
            raise ValueError("the model must have a piece for each byte")
        self.ids = {p: k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)) if kind == NORMAL}
        self.beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}


def merged(symbols: list[str], ids: dict[str, int], scores: list[float]) -> list[str]:
    """What remains of ``symbols`` when pairs that are pieces are merged, the best score and then the leftmost first."""
    symbols, n = list(symbols), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[float, int, int, int]] = []

    def enter(left: int, right: int) -> None:
        if left >= 0 and right < n and (k := ids.get(symbols[left] + symbols[right])) is not None:
            agenda.append((-scores[k], left, right, len(symbols[left]) + len(symbols[right])))

    for left in range(n - 1):
        enter(left, left + 1)
    heapq.heapify(agenda)
    while agenda:
        _, left, right, size = heapq.heappop(agenda)
        if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
            continue  # one of the two has been merged meanwhile
        symbols[left] += symbols[right]
        symbols[right] = ""
        after[left] = after[right]
        if after[right] < n:
            before[after[right]] = left
        held = len(agenda)
        enter(before[left], left)
        enter(left, after[left])
        fresh = agenda[held:]
        del agenda[held:]
        for pair in fresh:
            heapq.heappush(agenda, pair)
    return [s for s in symbols if s]


class Agenda:
    """The agendas of many short segments at once, as arrays; long segments have a heap each (``merged``).

    Symbols are numbers: the pieces' ids, then characters that only stand inside pieces, and below 0 all others. In a
    round each segment merges the head of its agenda; a segment leaves when its agenda is empty.
    """

    def __init__(self, model: Model):
        self.model, n = model, len(model.pieces)
        inside = sorted({c for p in model.ids for c in p} - set(model.ids))
        number = model.ids | {c: n + k for k, c in enumerate(inside)}
        self.n, self.width = n, n + len(inside)
        self.inside = np.array([ord(c) for c in inside], np.int64)
        self.symbol = -1 - np.arange(0x110000, dtype=np.int64)
        for c, k in number.items():
            if len(c) == 1:
                self.symbol[ord(c)] = k
        pairs = {number[p[:k]] * self.width + number[p[k:]]: i for p, i in model.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.keys = np.array(sorted(pairs) or [-1], np.int64)
        self.into = np.array([pairs.get(k, 0) for k in self.keys.tolist()], np.int64)
        rank = np.unique(-np.array(model.scores), return_inverse=True)[1]
        self.rank = rank[self.into].astype(np.int64)
        self.beside = np.array(sorted(number[a] * self.width + number[b] for a, b in model.beside) or [-1], np.int64)

    def _found(self, keys: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        asked = np.where((left >= 0) & (right >= 0), left * self.width + right, -2)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return at, keys[at] == asked

    def cut(self, stretches: list[str]) -> tuple[list[str], np.ndarray]:
        """The segments of all stretches in a row, and each stretch's number of them."""
        joined = "".join(stretches)
        symbols = self.symbol[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        held = np.concatenate([self._found(self.beside, symbols[:-1], symbols[1:])[1], [False]])
        ends = np.cumsum(np.fromiter(map(len, stretches), np.int64, len(stretches)))
        held[ends - 1] = False
        stops = np.flatnonzero(~held) + 1
        segments = [joined[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        return segments, np.diff(np.searchsorted(stops, ends, "right"), prepend=0)

    def _pairs(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs that begin ``at`` stand in the agenda (later than all if they are no piece), and their pieces."""
        place, found = self._found(self.keys, symbols[at], symbols[at + 1])
        return np.where(found, self.rank[place], NEVER), self.into[place]

    def merge(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that remain of short segments, in a row, and each segment's number of them."""
        symbols = self.symbol[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        own = np.arange(len(segments))
        rank, into = np.full(len(symbols), NEVER), np.zeros(len(symbols), np.int64)
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        at = np.flatnonzero(~last)
        rank[at], into[at] = self._pairs(symbols, at)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(own):
            head = np.minimum.reduceat((rank << 32) + np.arange(len(rank)), np.cumsum(sizes) - sizes)
            live = head >> 32 < NEVER
            if not live.all():
                stays = np.repeat(live, sizes)
                done.append((own[~live], sizes[~live], symbols[~stays]))
                before = np.cumsum(~stays)
                head = head[live] - before[head[live] & LOW]
                symbols, rank, into, last = symbols[stays], rank[stays], into[stays], last[stays]
                own, sizes = own[live], sizes[live]
                if not len(own):
                    break
            at = head & LOW
            symbols[at] = into[at]
            last[at] = last[at + 1]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            symbols, rank, into, last = symbols[kept], rank[kept], into[kept], last[kept]
            sizes = sizes - 1
            at = at - np.arange(len(at))  # each segment before has lost one symbol
            rank[at] = NEVER
            right = at[~last[at]]
            rank[right], into[right] = self._pairs(symbols, right)
            left = at[(at > 0) & ~last[at - 1]] - 1
            rank[left], into[left] = self._pairs(symbols, left)
        who, all_sizes, every = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(who)
        starts = np.cumsum(all_sizes) - all_sizes
        return gathered(every, starts[order], all_sizes[order]), all_sizes[order]

    def spelt(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of symbols: those that are no pieces fall into their bytes."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.n))
        if not len(odd):
            return symbols.astype("<u4"), sizes
        points = np.where(symbols[odd] < 0, -1 - symbols[odd], self.inside[np.maximum(symbols[odd] - self.n, 0)] if len(self.inside) else 0)
        lengths = np.ones(len(symbols), np.int64)
        lengths[odd] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        starts = np.cumsum(lengths) - lengths
        out = np.repeat(symbols, lengths)
        byte_ids = np.array([self.model.byte_ids[b] for b in range(256)])
        raw = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        out[np.repeat(starts[odd] - (np.cumsum(lengths[odd]) - lengths[odd]), lengths[odd]) + np.arange(len(raw))] = byte_ids[raw]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(sizes)
        return out.astype("<u4"), upto[ends] - upto[ends - sizes]

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct segments in a row, and each segment's number of them."""
        m = self.model
        short = [k for k, s in enumerate(segments) if len(s) <= SHORT]
        symbols, sizes = self.merge([segments[k] for k in short]) if short else (np.zeros(0, np.int64),) * 2
        if len(short) < len(segments):
            long = [k for k, s in enumerate(segments) if len(s) > SHORT]
            every = [[m.ids.get(s, int(self.symbol[ord(s[0])])) for s in merged(segments[k], m.ids, m.scores)] for k in long]
            symbols = np.concatenate([symbols, *(np.array(x, np.int64) for x in every)])
            sizes = np.concatenate([sizes, np.array([len(x) for x in every], np.int64)])
            order = np.argsort(np.array(short + long))
            symbols, sizes = gathered(symbols, (np.cumsum(sizes) - sizes)[order], sizes[order]), sizes[order]
        return self.spelt(symbols, sizes)


def _one_byte_on(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\N{REPLACEMENT CHARACTER}", error.start + 1


codecs.register_error("tessera_each_byte", _one_byte_on)


class Pieces:
    """Encoder and decoder of one model; ``check`` compares each newly learnt stretch with the library's ids."""

    def __init__(self, body: bytes, check: bool = True):
        self.model = m = Model(body)
        self.library = None
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=body)
        self.agenda = Agenda(m)
        self.learnt, self.segments = Learnt(self._learn, CACHE), Learnt(self.agenda.encode, CACHE)
        of_kind = {NORMAL: lambda p: p.replace(MARK, " ").encode(), UNKNOWN: lambda p: m.unknown_text, CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[1:-1], 16)])}
        self.token_bytes = Strings([of_kind[kind](p) for p, kind in zip(m.pieces, m.kinds, strict=True)])
        self.decimals = Strings([b"%d " % k for k in range(len(m.pieces))])
        self.marked = np.array([kind == NORMAL and p.startswith(MARK) for p, kind in zip(m.pieces, m.kinds, strict=True)])
        self.silent, self.unsure = np.array(m.kinds) == CONTROL, np.array(m.kinds) == BYTE

    def _learn(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches, given without their first blank."""
        cut, counts = self.agenda.cut([MARK + s.replace(" ", MARK) for s in stretches])
        kinds = dict.fromkeys(cut)
        numbers = self.segments.numbers(list(kinds))
        kinds.update(zip(kinds, numbers.tolist(), strict=True))
        at = np.fromiter(map(kinds.__getitem__, cut), np.int64, len(cut))
        each = self.segments.sizes[at]
        flat = gathered(self.segments.flat, self.segments.starts[at], each)
        upto = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
        if self.library is not None:
            wanted = self.library.encode(stretches, num_threads=1)
            mine = flat.tolist()
            for s, ids, a, b in zip(stretches, wanted, upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                if ids != mine[a:b] and s:  # a lone blank is no text to the library
                    raise RuntimeError(f"the library encodes {s!r} as {ids}, the agenda as {mine[a:b]}")
        return flat, np.diff(upto)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids before each text and at the end.

        A mark in a text is as good as a blank. Texts are cut at blanks; of several in a row all but the first go with the
        word behind them (or the text's end).
        """
        words = pc.split_pattern(pc.replace_substring(texts, MARK, " "), " ")
        coded = words.flatten().dictionary_encode()
        kinds, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        offsets = words.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        last = np.zeros(len(code), bool)
        last[offsets[1:] - 1] = True
        empty = code == (kinds.index("") if "" in kinds else -1)
        at = np.flatnonzero(~empty | last)
        blanks = at - np.concatenate([[-1], at[:-1]]) - 1
        kind = code[at].astype(np.int64)
        behind = np.flatnonzero(blanks)
        pairs, place = np.unique(blanks[behind] * len(kinds) + kind[behind], return_inverse=True)
        kind[behind] = len(kinds) + place
        numbers = self.learnt.numbers([*kinds, *(" " * int(p // len(kinds)) + kinds[int(p % len(kinds))] for p in pairs)])[kind]
        sizes = self.learnt.sizes[numbers]
        ends = np.searchsorted(at, offsets[1:] - 1) + 1  # a text's last word is always among those kept
        sizes[ends[(np.diff(offsets) == 1) & empty[offsets[1:] - 1]] - 1] = 0  # an empty text has no blank in front
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return gathered(self.learnt.flat.astype("<u4"), self.learnt.starts[numbers], sizes), upto[np.concatenate([[0], ends])]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: without the blank in front, and with U+FFFD for each byte that belongs to no character."""
        quiet = self.silent[ids]
        if self.unsure[ids].any():  # bytes with a control id between them are no character
            runs = [self.token_bytes.joined(x) for x in np.split(ids, np.flatnonzero(quiet))]
            data = b"".join(x.decode("utf-8", "tessera_each_byte").encode() for x in runs)
        else:
            data = self.token_bytes.joined(ids)
        spoken = np.flatnonzero(~quiet)
        return data[1:] if len(spoken) and self.marked[ids[spoken[0]]] else data


@functools.lru_cache(maxsize=2)
def pieces_of(path: str, check: bool) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read(), check)


def sentence_pieces(docs: DataFrame, path: str, end_id: int | None = None, with_ids: bool = True, check: bool = True) -> DataFrame:
    """Encode every whole text with the model at ``path``, append an end id and decode the ids again.

    Returns doc_id, n_tokens (all ids), ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the decoded
    text in UTF-8), round_trip (whether it equals the text: it does unless the text holds the mark itself) and, with
    ``with_ids``, the array ids. ``end_id`` is the model's own unless given; -1 appends none. A null text counts as empty:
    the end id alone. Repeated rows each give a row, a null doc_id stays null, an empty table gives none, and other columns
    are not carried. The work is one pass without a shuffle. With ``check`` a stretch that the library encodes otherwise
    raises RuntimeError.
    """
    out = StructType([docs.schema["doc_id"], *StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = pieces_of(path, check)
            end = pieces.model.end if end_id is None else end_id
            if end is None:
                raise ValueError("the model has no end id")
            tail = np.array([end] * (end >= 0), "<u4")
            for part, texts in slices_of(batch, SLICE, SLICE_BYTES):
                flat, at = pieces.encode_all(texts)
                ids = [np.concatenate([flat[a:b], tail]) for a, b in zip(at[:-1], at[1:], strict=True)]
                back = [pieces.decode(x) for x in ids]
                columns = [
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(pieces.decimals.joined(x)[:-1]).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                    pc.equal(pa.array(back, pa.binary()), texts.cast(pa.binary())),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=[f.name for f in out])

    return docs.select("doc_id", "text").mapInArrow(run, out)
