"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors can reach, under ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode with the setting unset, as in tests.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-tessera-", dir="/tmp")
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def materialise(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str, name: str) -> None:
    """Remove a table that nothing reads any more, as those of earlier rounds of a loop."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(batch: pa.RecordBatch, step: int = 256, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in slices with its texts as Python strings (null: empty), so that few are held at once."""
    for part, texts in slices_of(batch, step, most):
        yield part, texts.to_pylist()


def slices_of(batch: pa.RecordBatch, step: int = 256, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in slices of up to ``step`` rows and about ``most`` bytes of text, with the texts (null: empty)."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        end = min(start + step, max(start + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield batch.slice(start, end - start), texts.slice(start, end - start)
        start = end


def map_texts(docs: DataFrame, schema: str, per_batch: Callable[[pa.RecordBatch, list[str]], dict], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Apply ``per_batch`` to slices of ``docs``; it returns the columns that follow those in ``keep``."""
    from pyspark.sql.types import StructType

    out = StructType([docs.schema[c] for c in keep] + list(StructType.fromDDL(schema)))
    names = [f.name for f in out][len(keep) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in texts_of(batch):
                made = per_batch(part, texts)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(made[n]) if not isinstance(made[n], pa.Array) else made[n] for n in names)], names=[f.name for f in out])

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, out)


def spans_digest(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end``, comma-joined in the given order."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def cached_joins(cut: list[list[str]], cache: dict[str, bytes], limit: int, learn: Callable[[list[str]], None]) -> list[bytes | None]:
    """For each list of words the joined cached bytes; ``learn`` gets all words not in the cache, once.

    None for a list with a word that ``learn`` leaves out. The cache starts anew when it holds over ``limit``.
    """
    if len(cache) > limit:
        cache.clear()
    got = [list(map(cache.get, words)) for words in cut]
    lacking = [k for k, x in enumerate(got) if None in x]
    if lacking:
        learn(list(dict.fromkeys(w for k in lacking for w, x in zip(cut[k], got[k], strict=True) if x is None)))
        for k in lacking:
            got[k] = list(map(cache.get, cut[k]))
    return [None if k in again and None in x else b"".join(x) for again in [set(lacking)] for k, x in enumerate(got)]


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``starts``, one after the other."""
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return flat[shift + np.arange(len(shift))]


class Learnt:
    """Runs of numbers that belong to words, worked out once each; it starts anew when it holds over ``limit`` words.

    ``learn`` gets words and returns their runs' numbers in a row and the runs' sizes.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.learn, self.limit = learn, limit
        self.number: dict[str, int] = {}
        self.flat = self.starts = self.sizes = np.zeros(0, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The places of distinct words in ``starts`` and ``sizes``, good until the next call."""
        if len(self.number) > self.limit:
            self.number = {}
            self.flat = self.starts = self.sizes = np.zeros(0, np.int64)
        at = list(map(self.number.get, words))
        new = [w for w, k in zip(words, at, strict=True) if k is None]
        if new:
            first = len(self.number)
            flat, sizes = self.learn(new)
            self.number.update(zip(new, range(first, first + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat.astype(flat.dtype, copy=False), flat])
            at = list(map(self.number.get, words))
        return np.array(at, np.int64)

    def joined(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """For lists of words without blanks all their runs in a row, and where each list's begin and the last ends."""
        coded = words.flatten().dictionary_encode()
        kinds = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py().split(" ") if len(coded) else []
        kind = self.numbers(kinds)[coded.indices.to_numpy()]
        sizes = self.sizes[kind]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        offsets = words.offsets.to_numpy()
        return gathered(self.flat, self.starts[kind], sizes), ends[offsets - offsets[0]]


class Cutter:
    """Cuts texts into words by a table of bytes: runs of those with ``inside`` (256 booleans), A-Z lowered.

    All bytes of a character beyond ASCII must be alike, so that no character is cut.
    """

    def __init__(self, inside: np.ndarray):
        self.inside = inside
        self.lowered = np.arange(256, dtype=np.uint8)
        self.lowered[65:91] += 32

    def spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes, where each text begins and the last ends, which bytes are in words, and where words start."""
        texts = texts.cast(pa.large_binary())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        inside = self.inside[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        cut = at[at < len(data)]  # words end with their texts
        start[cut] = inside[cut]
        return data, at, inside, np.flatnonzero(start)

    def strings(self, data: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> pa.Array:
        """All words in a row, lowered."""
        flat = self.lowered[data[inside]]
        before = np.cumsum(inside)[starts] - 1 if len(starts) else starts
        offsets = np.append(before, len(flat)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.string())

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words in a row and the place of each one's text."""
        data, at, inside, starts = self.spans(texts)
        return self.strings(data, inside, starts), np.searchsorted(at, starts, "right") - 1
