"""Token-id files: documents compressed one by one with a shared zstandard dictionary, with an offset index.

The files are written and read by Spark, so they can live in any store Spark knows. A row is a block of
documents in ascending doc_id order: the dictionary's hash, the documents' ids, offsets and token counts, and the
concatenated zstandard frames. The dictionary is a table of one row beside them.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Learnt, gathered, slices_of

#: Pieces whose ids a Python worker keeps; it starts anew when there are more. Only speed depends on it.
CACHE = 900_000
#: Words with none of these characters are in normal form, have one lower form, and fall into these pieces.
ODD = r"[^\x21-\x7EÀ-ÖØ-öø-ÿ]"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+"
#: A block ends at this many payload bytes or documents.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
#: Texts that are cut into words at a time, and about how many bytes of them.
SLICE, SLICE_BYTES = 4000, 6 << 20
#: Documents whose ids train the dictionary, those of the smallest hashes among texts of up to so many characters, which
#: bounds what the driver gets; it only affects the size of the files.
DICTIONARY_DOCS, DICTIONARY_CHARS, DICTIONARY_BYTES = 2000, 20_000, 112_640

BLOCK_SCHEMA = "part int, seq int, start_in_part long, n_tokens long, first_doc_id long, last_doc_id long, dictionary string, doc_ids array<long>, counts array<long>, offsets array<long>, payload binary"


class Words:
    """Encodes texts with the tokenizers library, each distinct piece of a word once.

    The tokenizer must split at white space, as the one given does: its pattern has no match that holds a blank,
    and its normaliser works on each code point or on marks that follow a letter. Words without ODD characters are
    lowered and cut into pieces by Arrow, so that the library has but its merges to do; its model ends each piece
    with a token of its own, by which the pieces are told apart. Other words take the whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for t, k in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([ODD, *added])
        self.pieces, self.whole = Learnt(self._piece_ids, CACHE), Learnt(self._whole_ids, CACHE)
        if not suffix or not self._pieces_agree():
            self.odd = ".*"

    def _pieces_agree(self) -> bool:
        """Whether the tokenizer cuts and lowers characters that are not ODD as PIECE says."""
        every = [c for c in map(chr, range(0x21, 0x180)) if not re.match(ODD, c)]
        sample = ["it's", "I'LL", "a1b22", "x,;y", *(f"a{c}{c}9{c}" for c in every)]
        return self.encode_all(pa.array([" ".join(sample)]))[0].tolist() == self.tokenizer.encode(" ".join(sample), add_special_tokens=False).ids

    def _piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.merges.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        filled = np.fromiter(map(bool, pieces), bool, len(pieces))
        sizes = np.zeros(len(pieces), np.int64)
        sizes[filled] = np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0)
        return ids, sizes

    def _whole_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words in one call, told apart by the places of their tokens."""
        got = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(got.ids, "<u4")
        at = np.fromiter((s for s, _ in got.offsets), np.int64, len(ids))
        ends = np.searchsorted(at, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1), "left")
        return ids, np.diff(ends, prepend=0)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids before each text and at the end."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        kinds = coded.dictionary
        odd = pc.match_substring_regex(kinds, self.odd)
        cut = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(kinds.filter(pc.invert(odd))), PIECE, r"\0 "), " ")
        flat, ends = self.pieces.joined(cut)
        rest = kinds.filter(odd)
        whole, whole_ends = self.whole.joined(pa.ListArray.from_arrays(pa.array(range(len(rest) + 1), pa.int32()), rest))
        order = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")  # where the pieces' words and the others stand
        starts, sizes = np.empty(len(kinds), np.int64), np.empty(len(kinds), np.int64)
        starts[order] = np.concatenate([ends[:-1], len(flat) + whole_ends[:-1]])
        sizes[order] = np.concatenate([np.diff(ends), np.diff(whole_ends)])
        kind = coded.indices.to_numpy()
        ids = gathered(np.concatenate([flat, whole]).astype("<u4"), starts[kind], sizes[kind])
        offsets = words.offsets.to_numpy()
        return ids, np.concatenate([[0], np.cumsum(sizes[kind])])[offsets - offsets[0]]


@functools.lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A zstandard dictionary from the id arrays of a bounded set of documents (empty if there are too few)."""
    docs = docs.filter(F.length("text") <= DICTIONARY_CHARS)
    ids = [r[0] for r in docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICTIONARY_DOCS).collect()]
    if not ids:
        return b""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices_of(batch, SLICE, SLICE_BYTES):
                ids, at = words_of(tokenizer).encode_all(texts)
                yield pa.record_batch([pa.array([ids[a:b].tobytes() + end for a, b in zip(at[:-1], at[1:], strict=True)])], names=["ids"])

    samples = [bytes(r[0]) for r in docs.select("doc_id", "text").filter(F.col("doc_id").isin(ids)).mapInArrow(run, "ids binary").limit(2 * DICTIONARY_DOCS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(samples)).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return b""


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode every whole text, append ``end_id`` and write the ids at ``path`` in ascending doc_id order.

    A null text is an empty one: its ids are the end id alone. A null doc_id sorts first. Repeated ids keep a
    place each, in the order of their text. An empty table writes the dictionary alone. Other columns are not
    written. One range shuffle of doc_id and text; no group is collected.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "hash string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        part, seq, done, end = TaskContext.get().partitionId(), 0, 0, end_id.to_bytes(4, "little")
        ids, counts, offsets, frames, size = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = [part, seq, done, sum(counts), min(known, default=None), max(known, default=None), digest, ids, counts, offsets, b"".join(frames)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for rows, texts in slices_of(batch, SLICE, SLICE_BYTES):
                flat, at = words_of(tokenizer).encode_all(texts)
                for doc_id, a, b in zip(rows.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    tokens = flat[a:b].tobytes() + end
                    frames.append(packer.compress(tokens))
                    ids.append(doc_id)
                    counts.append(len(tokens) // 4)
                    offsets.append(size)
                    size += len(frames[-1])
                    if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                        yield block()
                        seq, done = seq + 1, done + sum(counts)
                        ids, counts, offsets, frames, size = [], [], [], [], 0
        if ids:
            yield block()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    """The dictionary, checked against its hash."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row["bytes"]).hexdigest() != row["hash"]:
        raise ValueError(f"the dictionary in {path} does not match its hash")
    return bytes(row["bytes"])


def _frames(dictionary: bytes, digest: str, payload: bytes, offsets: list[int], want: list[int]) -> Iterator[np.ndarray]:
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("a block was written with another dictionary")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    ends = [*offsets[1:], len(payload)]
    for k in want:
        yield np.frombuffer(unpack.decompress(payload[offsets[k] : ends[k]]), "<u4")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Read token files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids.

    Only one number a written partition (bounded by the number of shuffle partitions) is broadcast.
    """
    dictionary = read_dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                start, made = row["part_start"] + row["start_in_part"], [[], [], [], [], []]
                tokens = _frames(dictionary, row["dictionary"], row["payload"], row["offsets"], list(range(len(row["offsets"]))))
                for doc_id, ids in zip(row["doc_ids"], tokens, strict=True):
                    for column, value in zip(made, (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids), strict=True):
                        column.append(value)
                    start += len(ids)
                columns = [pa.array(c, pa.int64()) for c in made[:4]] + [pa.array([x.tolist() for x in made[4]], pa.list_(pa.int64()))] * with_ids
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    rows = blocks.join(F.broadcast(parts), F.col("part") == F.col("p")).select("part_start", "start_in_part", "dictionary", "doc_ids", "offsets", "payload")
    return rows.mapInArrow(run, schema)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document: the scan prunes to its block by the id range, and one frame is decompressed."""
    dictionary = read_dictionary(spark, path)
    found = spark.read.parquet(f"{path}/blocks").filter((F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id)).filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).first()
    if found is None:
        return None
    return next(_frames(dictionary, found["dictionary"], bytes(found["payload"]), found["offsets"], [found["doc_ids"].index(doc_id)])).tolist()
