"""Byte-level BPE through sentencepiece: the rank file is serialised as a sentencepiece BPE model.

Each byte is mapped to one code point, each vocabulary entry is a piece scored by its negative rank, and the
normaliser is the identity, so that sentencepiece's best-score-first merges are the lowest-rank-first merges
of the rank file. Pre-tokens are encoded one by one; ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.shared import cached_joins, map_texts

#: Fixed values of the sentencepiece model format: piece types and the model type for BPE.
NORMAL, UNKNOWN, BPE = 1, 2, 2
#: Bytes become the code points from here on (no white space, nothing that sentencepiece escapes).
BYTE_BASE = 0x100
#: Stretches whose ids a Python worker keeps; it starts anew when there are more. Only speed depends on it.
CACHE = 300_000


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def mapped(token: bytes) -> str:
    return "".join(chr(BYTE_BASE + b) for b in token)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks."""
    pieces = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if rank != len(pieces):
            raise ValueError("ranks must be 0, 1, 2, ... without gaps")
        pieces.append(_block(1, _block(1, mapped(token).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, NORMAL)))
    pieces.append(_block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, UNKNOWN)))
    trainer = _block(2, _number(3, BPE) + _number(4, len(pieces)))
    normaliser = _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return b"".join(pieces) + trainer + normaliser


class ByteBpe:
    """Encoder and decoder for one rank file and one pre-token pattern.

    Ids are kept packed as little-endian 32-bit integers. A text is cut at each single blank between two
    characters that are not white space: the pattern has no match across such a place, since a match can only
    begin with a blank. The stretches, most of them words, are encoded once and kept.
    """

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.split = regex.compile(pattern).findall
        tokens = [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.token_bytes = Strings(tokens)
        self.decimals = Strings([b"%d " % i for i in range(len(tokens))])
        self.table = [chr(BYTE_BASE + b) for b in range(256)]
        self.cache: dict[str, bytes] = {}

    def _pretokens(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens: one that is in the vocabulary is one id; the others go through sentencepiece."""
        raw = [w.encode() for w in words]
        out = [None if (r := self.ranks.get(w)) is None else r.to_bytes(4, "little") for w in raw]
        rest = [k for k, x in enumerate(out) if x is None]
        if rest:
            table = self.table.__getitem__
            for k, ids in zip(rest, self.pieces.encode(["".join(map(table, raw[k])) for k in rest], num_threads=1), strict=True):
                out[k] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _stretches(self, stretches: list[str]) -> list[bytes]:
        parts = [self.split(s) for s in stretches]
        kinds = list(dict.fromkeys(chain.from_iterable(parts)))
        ids = dict(zip(kinds, self._pretokens(kinds), strict=True))
        return [b"".join(map(ids.__getitem__, p)) for p in parts]

    def _learn(self, stretches: list[str]) -> None:
        good = [w for w in stretches if w.strip(" ") and not w[-1].isspace() and not w[w[0] == " "].isspace()]
        self.cache.update(zip(good, self._stretches([w[1:] if w[0] == " " else f" {w}" for w in good]), strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. A text's first stretch is kept under a key with a blank, as no later one has."""
        cut = [t.split(" ") for t in texts]
        for words in cut:
            words[0] = " " + words[0]
        got = cached_joins(cut, self.cache, CACHE, self._learn)
        return [self._stretches([t])[0] if x is None else x for t, x in zip(texts, got, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes.joined(ids)


class Strings:
    """A table of byte strings that can be joined by an array of indexes."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        shift = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[shift + np.arange(len(shift))].tobytes()


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def byte_bpe(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the decoded
    bytes), round_trip (decoded bytes equal the text's) and, with ``with_ids``, the array ids. A null text counts
    as empty: no ids, digests of nothing. Repeated rows each give a row, a null doc_id stays null, and other
    columns are not carried. The work is one pass without a shuffle; the tokenizer file is read by each worker.
    """

    def per_batch(_: pa.RecordBatch, texts: list[str]) -> dict:
        bpe = codec(path, pattern)
        ids = [np.frombuffer(x, "<u4") for x in bpe.encode_all(texts)]
        back = [bpe.decode(x) for x in ids]
        made = {
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(bpe.decimals.joined(x)[:-1]).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in back],
            "round_trip": [b == t.encode() for b, t in zip(back, texts, strict=True)],
        }
        return made | ({"ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))} if with_ids else {})

    return map_texts(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids, per_batch)
