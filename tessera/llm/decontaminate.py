"""Benchmark decontamination: a BM25 inverted index of the test items, searched by block-max WAND.

Every passage of every document (two cells of CELL words, a new one each CELL words) is a query. Scores are parts of
an item's own score, so that one threshold holds for all items. A passage is only searched if it holds enough of
some item's rarest words to pass the threshold with all its other words: an upper bound, computed for a whole
document at once. Retrieved items are verified by the overlap of their question's and their answer's word triples (pairs or words,
where a part has no three words).

The index is built in shards of about SHARD_WORDS words of items. One shard at a time is held by the driver and
broadcast; more items mean more shards, each searched by all passages, with word statistics over all items.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import gathered, materialise, shared_dir, slices_of, texts_of

CELL, SHARD_WORDS = 64, 400_000
#: BM25's constants; entries of a posting list that share a block maximum.
K1, B, BLOCK = 1.2, 0.75, 16
#: Part of an item's score that its commonest words may hold without a posting in the bound.
SLACK = 0.3
#: What is no part of a word; texts that are cut into words at a time, and about how many bytes of them.
GAP = r"[^\pL\pN_]+"
SLICE, SLICE_BYTES = 1000, 4 << 20


def cut(texts: pa.Array) -> pa.ListArray:
    """The lower-cased words of each text (one empty word if there are none)."""
    return pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), GAP, " "), " "), " ")


def words_of(text: str) -> list[str]:
    return [w for w in cut(pa.array([text]))[0].as_py() if w]


def question_and_answer(text: str) -> tuple[int, int]:
    """The number of words of an item's question and of its answer: the last sentence, or the last quarter."""
    total = len(words_of(text))
    ends = [m.end() for m in re.finditer(r"[.!?]\s+", text.rstrip())]
    answer = len(words_of(text[ends[-1] :])) if ends else 0
    answer = answer if 3 <= answer <= total // 2 else max(1, total // 4)
    return total - answer, answer


def chunks_of(words: list[str]) -> list[list[str]]:
    return [words[k : k + CELL] for k in range(0, len(words), CELL)]


class Index:
    """Posting lists over chunks of items, with impacts relative to a chunk's own score and block maxima."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_chunks: int, mean: float):
        self.terms: dict[str, int] = {}
        self.items: list[int] = []  # the number of each chunk's item in ``parts``
        self.parts: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        bound: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for item, text in sorted(items):
            words = words_of(text)
            ids = np.array([self.terms.setdefault(w, len(self.terms)) for w in words], np.int64)
            question = question_and_answer(text)[0] if words else 0
            self.parts.append((item, ids[:question], ids[question:], len(words)))
            for chunk in chunks_of(words):
                tf = Counter(chunk)
                weight = {self.terms[w]: math.log(1 + (n_chunks - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(chunk) / mean)) for w, n in tf.items()}
                own, common = sum(weight.values()), 0.0
                for t, w in sorted(weight.items(), key=lambda x: (x[1], x[0])):
                    postings[t].append((len(self.items), w / own))
                    common += w / own
                    if common > SLACK:
                        bound[t].append((len(self.items), w / own))
                self.items.append(len(self.parts) - 1)
        self.lists = {t: ([c for c, _ in p], [w for _, w in p]) for t, p in postings.items()}
        self.most = {t: max(w) for t, (_, w) in self.lists.items()}
        self.block_most = {t: [max(w[k : k + BLOCK]) for k in range(0, len(w), BLOCK)] for t, (_, w) in self.lists.items()}
        n = len(self.terms)
        self.bound_size = np.array([len(bound.get(t, ())) for t in range(n)], np.int64)
        self.bound_start = np.cumsum(self.bound_size) - self.bound_size
        flat = [x for t in range(n) for x in bound.get(t, ())]
        self.bound_chunk, self.bound_weight = np.array([c for c, _ in flat], np.int64), np.array([w for _, w in flat])
        self.vocabulary = pa.array(list(self.terms), pa.string())

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers of all words in a row, -1 for words of no item, and where each text's begin and the last ends."""
        words = cut(texts)
        offsets = words.offsets.to_numpy().astype(np.int64)
        return pc.fill_null(pc.index_in(words.flatten(), self.vocabulary), -1).to_numpy().astype(np.int64), offsets - offsets[0]

    def passages(self, ids: np.ndarray, ends: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """Text and first cell of each passage that may pass the threshold for some chunk.

        The cells of all texts are numbered in a row, with a free number before each text's first: a passage is named
        by its first cell, and the first cell is also in the passage that would begin before it.
        """
        cells = -(-np.diff(ends) // CELL) + 1
        first = np.cumsum(cells) - cells + 1
        at = np.flatnonzero(np.append(self.bound_size, 0)[ids])
        if not len(at):
            return []
        text = np.searchsorted(ends, at, "right") - 1
        size = self.bound_size[ids[at]]
        entry = gathered(np.arange(len(self.bound_chunk)), self.bound_start[ids[at]], size)
        own = np.repeat(first[text] + (at - ends[text]) // CELL, size) * len(self.items) + self.bound_chunk[entry]
        key, back = np.unique(own, return_inverse=True)
        mass = np.bincount(back, self.bound_weight[entry])
        after = np.searchsorted(key, key + len(self.items))
        both = mass + np.where(key[np.minimum(after, len(key) - 1)] == key + len(self.items), mass[np.minimum(after, len(key) - 1)], 0.0)
        least = threshold - SLACK - 1e-9
        passage = np.concatenate([key[both >= least] // len(self.items), key[mass >= least] // len(self.items) - 1])
        passage = np.unique(passage)
        text = np.searchsorted(first - 1, passage, "right") - 1
        return sorted(set(zip(text.tolist(), np.maximum(passage - first[text], 0).tolist(), strict=True)))

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All chunks that score at least ``threshold`` for the distinct ``terms``, by block-max WAND."""
        cursors = [[self.lists[t][0][0], 0, t] for t in terms.tolist()]  # chunk, place in the list, term
        found = []
        while True:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                total += self.most[t]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            chunk = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == chunk:
                pivot += 1
            bound, nearest = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.items)
            for _, p, t in cursors[: pivot + 1]:
                chunks = self.lists[t][0]
                block = bisect_left(chunks, chunk, p) // BLOCK
                if block * BLOCK < len(chunks):
                    bound += self.block_most[t][block]
                    nearest = min(nearest, chunks[min(len(chunks), (block + 1) * BLOCK) - 1] + 1)
            if bound >= threshold:
                score = 0.0
                for _, p, t in cursors[: pivot + 1]:
                    k = bisect_left(self.lists[t][0], chunk, p)
                    if k < len(self.lists[t][0]) and self.lists[t][0][k] == chunk:
                        score += self.lists[t][1][k]
                if score >= threshold:
                    found.append((chunk, score))
                target = chunk + 1
            else:
                target = max(nearest, chunk + 1)
            moved = []
            for k, (c, p, t) in enumerate(cursors):
                if k <= pivot and c < target:
                    p = bisect_left(self.lists[t][0], target, p)
                    if p == len(self.lists[t][0]):
                        continue
                    c = self.lists[t][0][p]
                moved.append([c, p, t])
            cursors = moved

    def leaks(self, texts: pa.Array, threshold: float, overlap: float) -> list[list[tuple[int, float, float, float, int]]]:
        """Verified items of each text: item, score, overlap of question and answer, passages."""
        every, ends = self.ids(texts)
        best: list[dict[int, list]] = [{} for _ in range(len(texts))]
        for text, cell in self.passages(every, ends, threshold):
            ids = every[ends[text] : ends[text + 1]]
            passage = ids[cell * CELL : (cell + 2) * CELL]
            for chunk, score in self.search(np.unique(passage[passage >= 0]), threshold):
                item, question, answer, length = self.parts[self.items[chunk]]
                near = ids[max(0, cell * CELL - length) : (cell + 2) * CELL + length]
                q, a = (float(np.isin(grams(x, most), grams(near, most)).mean()) if len(x) else 1.0 for x in (question, answer) for most in [min(3, len(x))])
                if q >= overlap and a >= overlap:
                    row = best[text].setdefault(item, [0.0, 0.0, 0.0, 0])
                    row[:] = max(row[0], round(score, 9)), max(row[1], q), max(row[2], a), row[3] + 1
        return [[(item, *row) for item, row in sorted(found.items())] for found in best]


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """The distinct runs of ``n`` (1 to 3) neighbouring words, as numbers."""
    x = ids + 2
    out = x[: len(x) - n + 1]
    for k in range(1, n):
        out = out << 21 ^ x[k : len(x) - n + 1 + k]
    return np.unique(out)


def shards_of(items: DataFrame) -> Iterator[Index]:
    """Indexes over all items with a text, one at a time, with statistics over all of them.

    Shards are dealt by the items' hashes. The words of an item are as many as its text has; it is never cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in texts_of(batch):
                df: Counter = Counter()
                total = chunks = 0
                for text in texts:
                    for chunk in chunks_of(words_of(text)):
                        df.update(set(chunk))
                        total, chunks = total + len(chunk), chunks + 1
                words = [*df, None, None]
                yield pa.record_batch([pa.array(words, pa.string()), pa.array([0] * len(df) + [1, 2], pa.int32()), pa.array([*df.values(), total, chunks], pa.int64())], names=["word", "what", "n"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    counts = rows.select("text").mapInArrow(run, "word string, what int, n long").groupBy("word", "what").agg(F.sum("n").alias("n")).cache()
    sums = {r["what"]: r["n"] for r in counts.filter("word is null").collect()}
    shards = max(1, math.ceil(sums.get(1, 0) / SHARD_WORDS))
    for k in range(shards if sums.get(2) else 0):
        part = [(r[0], r[1]) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).distinct().collect()]
        words = sorted({w for _, t in part for w in words_of(t)})
        if words:
            wanted = items.sparkSession.createDataFrame([(w,) for w in words], "word string")
            df = {r["word"]: r["n"] for r in counts.filter("word is not null").join(wanted, "word", "left_semi").collect()}
            yield Index(part, df, sums[2], sums[1] / sums[2])
    counts.unpersist()


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.5) -> DataFrame:
    """Verified benchmark items in whole documents.

    Returns doc_id, item_id, score (part of the item chunk's own BM25 score), question_overlap, answer_overlap and
    n_passages, one row for each document row and item. A null or empty text has no passage; null items or items
    without words are not searched; all texts of an item_id that repeats are searched, and the best counts; without
    items the result is empty. Other columns are not carried. One pass over the documents for each
    shard, without a shuffle; what each pass finds is written to the shared folder.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, n_passages long"
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = shared_dir(spark)
    out = spark.createDataFrame([], schema)
    for k, index in enumerate(shards_of(items)):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices_of(batch, SLICE, SLICE_BYTES):
                    found = [(d, *x) for d, one in zip(part.column(0).to_pylist(), shared.value.leaks(texts, threshold, overlap), strict=True) for x in one]
                    columns = list(zip(*found, strict=True)) or [()] * 6
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

        one = materialise(rows.mapInArrow(run, schema), folder, f"leaks_{k}")
        out = out.union(one) if k else one
        shared.destroy()
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whole, that hold no verified item.

    A null or empty text holds none; repeated rows are judged alike; all columns are carried; an empty table gives an
    empty one. The rows that a shard leaves are written to the shared folder and are the next one's input.
    """
    folder = shared_dir(docs.sparkSession)
    for k, index in enumerate(shards_of(items)):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices_of(batch, SLICE, SLICE_BYTES):
                    yield part.filter(pa.array([not found for found in shared.value.leaks(texts, threshold, overlap)], pa.bool_()))

        docs = materialise(docs.mapInArrow(run, docs.schema), folder, f"left_{k}")
        shared.destroy()
    return docs
