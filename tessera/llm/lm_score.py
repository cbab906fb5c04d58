"""Language-model scoring by cross-entropy difference.

Two n-gram models over the same tokens (bytes), of the same order and smoothing, are counted on a target set and on
all documents; they share one vocabulary, the 256 bytes and the start mark. A document's score is the mean over its
tokens of the target model's loss less the background model's: the lower, the more it is like the target.

The table of n-grams is never broadcast, since it grows with the corpus. Documents are laid out in blocks of bounded
size; each block asks for the distinct n-grams it holds, by a join, and is scored with those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, shared_dir, texts_of

ORDER = 5
#: Pseudo-tokens that a context spreads by the next lower order; bytes of text in a block.
PSEUDO, BLOCK_BYTES = 5.0, 8 << 20


def grams(text: str) -> np.ndarray:
    """For each byte of the text the number made of it and the ORDER - 1 bytes before it (0 before the start)."""
    data = np.frombuffer(b"\0" * (ORDER - 1) + text.encode(), np.uint8).astype(np.int64)
    n = len(data) - ORDER + 1
    out = np.zeros(n, np.int64)
    for k in range(ORDER):
        out = out << 8 | data[k : k + n]
    return out


def _in_blocks(docs: DataFrame) -> DataFrame:
    """Add ``block``: consecutive rows of a task, BLOCK_BYTES of text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part, texts in texts_of(batch, 64):
                yield part.append_column("block", pa.array([block] * len(texts), pa.int64()))
                size += sum(map(len, texts))
                if size >= BLOCK_BYTES:
                    block, size = block + 1, 0

    return docs.mapInArrow(run, "doc_id long, target boolean, text string, block long")


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(back, np.concatenate([p[k] for p in parts]), len(keys)).astype(np.int64) for k in (1, 2))


def _block_counts(blocked: DataFrame) -> DataFrame:
    """block, gram, n_target, n_all: the distinct n-grams of each block of a task and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []

        def made() -> pa.RecordBatch:
            keys, target, every = _merged(parts)
            return pa.record_batch([pa.array(np.full(len(keys), block)), pa.array(keys), pa.array(target), pa.array(every)], names=["block", "gram", "n_target", "n_all"])

        for batch in batches:
            for part, texts in texts_of(batch, 64):
                blocks = part.column(0).to_numpy()
                target = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for b in np.unique(blocks).tolist():
                    if b != block and parts:
                        yield made()
                        parts = []
                    block = b
                    for flag in (False, True):
                        found = [grams(t) for t, x, f in zip(texts, blocks, target, strict=True) if x == b and f == flag]
                        if found:
                            keys, n = np.unique(np.concatenate(found), return_counts=True)
                            parts.append((keys, n * flag, n))
                    if len(parts) > 40:
                        parts = [_merged(parts)]
        if parts:
            yield made()

    return blocked.select("block", "target", "text").mapInArrow(run, "block long, gram long, n_target long, n_all long")


def model(counts: DataFrame, folder: str) -> DataFrame:
    """gram, ce_target, ce_all: each n-gram's loss in nats under both models, smoothed by the lower orders.

    An order's probability is (count + PSEUDO * lower order's) / (context's count + PSEUDO); below order 1 all 256
    bytes are alike. Lower orders and contexts are sums of the highest order's counts.
    """
    lower = None
    for order in range(1, ORDER + 1):
        mask = F.lit((1 << 8 * order) - 1)
        level = counts.groupBy(F.col("gram").bitwiseAND(mask).alias("g")).agg(F.sum("n_target").alias("t"), F.sum("n_all").alias("a"))
        context = level.groupBy(F.shiftright("g", 8).alias("h")).agg(F.sum("t").alias("ht"), F.sum("a").alias("ha"))
        rows = level.withColumn("h", F.shiftright("g", 8)).join(context, "h")
        if lower is None:
            rows = rows.withColumns({"pt": F.lit(1 / 256), "pa": F.lit(1 / 256)})
        else:
            rows = rows.withColumn("l", F.col("g").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))).join(lower, "l")
        p = {x: (F.col(c) + PSEUDO * F.col(q)) / (F.col(h) + PSEUDO) for x, c, q, h in (("pt", "t", "pt", "ht"), ("pa", "a", "pa", "ha"))}
        lower = materialise(rows.select(F.col("g").alias("l"), p["pt"].alias("pt"), p["pa"].alias("pa")), folder, f"order_{order}")
    return lower.select(F.col("l").alias("gram"), (-F.log("pt")).alias("ce_target"), (-F.log("pa")).alias("ce_all"))


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Score every whole text against the target set (``target``: the doc_ids of its documents).

    Returns doc_id, n_tokens, ce_target, ce_background (nats a token) and ce_difference (null for an empty or null
    text). Repeated rows each give a row, and count each; a null doc_id is not in the target; ids that repeat in
    ``target`` count once. Without target documents the target model is the uniform one. Other columns are not
    carried. What is shuffled are the texts once and each block's distinct n-grams.
    """
    folder = shared_dir(docs.sparkSession)
    ids = target.select(F.col("doc_id").cast("long").alias("_id")).filter("_id is not null").distinct()
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("_id"), "left")
    blocked = materialise(_in_blocks(marked.select("doc_id", F.col("_id").isNotNull().alias("target"), "text")), folder, "blocks")
    held = materialise(_block_counts(blocked), folder, "block_counts")
    counts = materialise(held.groupBy("gram").agg(F.sum("n_target").alias("n_target"), F.sum("n_all").alias("n_all")), folder, "counts")
    wanted = held.select("block", "gram").join(model(counts, folder), "gram")

    def score(rows: pa.Table, losses: pa.Table) -> pa.Table:
        gram = losses.column("gram").to_numpy()
        order = np.argsort(gram)
        gram, columns = gram[order], [losses.column(c).to_numpy()[order] for c in ("ce_target", "ce_all")]
        n, made = [], ([], [])
        texts = rows.column("text")
        for k in range(rows.num_rows):
            own = grams(texts[k].as_py() or "")
            at = np.searchsorted(gram, own)
            n.append(len(own))
            for out, c in zip(made, columns, strict=True):
                out.append(float(c[at].mean()) if len(own) else None)
        difference = [None if t is None else t - a for t, a in zip(*made, strict=True)]
        return pa.table([rows.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x, pa.float64()) for x in (*made, difference))], names=["doc_id", "n_tokens", "ce_target", "ce_background", "ce_difference"])

    # About a block a task, however many there are: a task's memory does not grow with the input.
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocked.select("block").distinct().count())
    dealt = blocked.select("block", "doc_id", "text").repartition(n, "block").groupBy("block")
    return dealt.cogroup(wanted.repartition(n, "block").groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, ce_target double, ce_background double, ce_difference double")
