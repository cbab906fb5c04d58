"""MinHash near-duplicates with an LSH forest.

1. Each text becomes the set of its hashed 5-word shingles and a MinHash signature; equal sets are one node.
2. The forest: the signature is read in several orders of SHALLOW values and as many more. In an order the nodes are
   sorted, and those with a long common prefix stand together. A region is the nodes with a common prefix of SHALLOW
   values; where it has more than REGION nodes, it is cut at the least further depth that makes its parts that small.
3. In a region, neighbours in the order (those with the longest common prefixes) are candidates first, then all
   others not yet joined through them; a sketch of the signature (2 bits a value) tells which may be similar enough.
   A region gives a spanning forest of those, not all pairs; the connected components are the clusters.
4. What a cut region may have missed are pairs of different clusters. Of each such region the nodes outside its
   commonest cluster are compared with all its nodes, in blocks: depth changes the work, not what is found.
5. Within a cluster links are confirmed on the full sets: 100 * intersection >= percent * union. Clusters of more than
   a block are dealt into blocks that share a few pivots; then those outside the cluster's largest confirmed class are
   compared with all of it. A pair is only left untested if both are already known to be linked through others.

At a similarity of 0.85 a pair shares a prefix of 4 values in one of 16 orders but for 1 pair in 130,000, at every size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, materialise, shared_dir, slices_of

SHINGLE, PERCENT = 5, 85
TREES, SHALLOW, DEPTH = 16, 4, 8
#: Nodes of a region or a part of it, nodes and shingles of a block of a cluster, that are compared at a time.
REGION, BLOCK, BLOCK_SHINGLES = 512, 128, 2_000_000
#: The two bits of a signature's value that the sketch holds.
SKETCH_BITS = (8, 9)
#: Nodes of a large cluster that all its blocks hold.
PIVOTS = 8

_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(0, 1 << 31, (TREES * DEPTH, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, (TREES * DEPTH, 1), np.uint32)
_PLACE = _RNG.integers(1, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE, _AT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SKETCH, PIVOT = ("s0", "s1", "s2", "s3"), ("pivot", "p0", "p1", "p2", "p3")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words in a row, and where each text's begin and the last ends.

    A word's hash is the mixed sum of what its bytes and their places mix to.
    """
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    flat, ends = words.flatten().cast(pa.large_binary()), words.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data, sizes = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], np.diff(at)
    filled = sizes > 0  # a text without words has one empty one
    sizes, ends = sizes[filled], np.concatenate([[0], np.cumsum(filled)])[ends]
    if not len(sizes):
        return np.zeros(0, np.uint64), ends
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(data)) - np.repeat(starts, sizes)).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(data * _BYTE + place * _AT), starts) + sizes.astype(np.uint64)), ends


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text of 1 to 4 words has one, of its whole sequence."""
    every, ends = word_hashes(texts)
    sets = []
    for start, end in zip(ends[:-1], ends[1:], strict=True):
        words = every[start:end]
        n = len(words) - SHINGLE + 1
        if not len(words):
            sets.append(words)
        elif n < 1:
            sets.append(_mix(np.array([(words * _PLACE[: len(words)]).sum() + np.uint64(len(words))], np.uint64)))
        else:
            h = words[:n] * _PLACE[0]
            for k in range(1, SHINGLE):
                h = h + words[k : k + n] * _PLACE[k]
            sets.append(np.unique(_mix(h)))
    return sets


def signature(hashes: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima of the upper halves of hashes, each under a permutation of its own."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(upper), 2048):
        low = np.minimum(low, (_MULTIPLY * upper[k : k + 2048] + _ADD).min(axis=1))
    return low


def _summaries(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's two 64-bit digests and the signature's bytes (null without a set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices_of(batch):
                sets = shingle_sets(texts)
                columns = [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(s.sum().astype(np.int64)) if len(s) else None for s in sets], pa.int64()),
                    pa.array([int(np.bitwise_xor.reduce(_mix(s)).astype(np.int64)) if len(s) else None for s in sets], pa.int64()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def _forest(nodes: DataFrame, trees: int) -> DataFrame:
    """A row for each node and order: the hash of its prefix, its place behind it (16 bits a value), and its sketch."""
    powers = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                n = batch.num_rows
                flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, TREES * DEPTH).astype(np.uint64)
                sig = flat.reshape(n, -1, SHALLOW)
                further = np.roll(sig, -1, axis=1)
                prefix = np.arange(trees, dtype=np.uint64)[None, :] + np.uint64(1)
                place = np.zeros((n, trees), np.uint64)
                for d in range(SHALLOW):
                    prefix = _mix(prefix * np.uint64(31) + sig[:, :trees, d])
                    place = place << np.uint64(16) | further[:, :trees, d] & np.uint64(0xFFFF)
                bits = [((flat[:, half * 64 : half * 64 + 64] >> np.uint64(b) & np.uint64(1)) * powers).sum(axis=1, dtype=np.uint64) for b in SKETCH_BITS for half in (0, 1)]
                columns = [np.repeat(batch.column(0).to_numpy(), trees), prefix.ravel().astype(np.int64), place.ravel().astype(np.int64)] + [np.repeat(b.astype(np.int64), trees) for b in bits]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["node", "region", "place", *SKETCH])

    return nodes.select("node", "signature").mapInArrow(run, "node long, region long, place long, s0 long, s1 long, s2 long, s3 long")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of equal leading columns in sorted rows, across batch borders; rows alone within a batch are passed over."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.logical_and.reduce([k[1:] == k[:-1] for k in (batch.column(c).to_numpy(zero_copy_only=False) for c in range(n_keys))])
        batch = batch.filter(pa.array(np.append(True, same) | np.append(same, True)))
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        cut = [0, *(np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1).tolist(), batch.num_rows]
        for start, end in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(k[start] for k in keys)
            if held and key != last:
                if len(held) > 1 or held[0].num_rows > 1:
                    yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if len(held) > 1 or held and held[0].num_rows > 1:
        yield pa.Table.from_batches(held)


class Linked:
    """Classes over 0..n-1 as an array; a class is named by its smallest member."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        x, y = self.of[a], self.of[b]
        if x == y:
            return False
        self.of[self.of == max(x, y)] = min(x, y)
        return True


def _near(sketch: np.ndarray, one: np.ndarray, most: int) -> np.ndarray:
    """Which sketches (4 words a column) differ from one of them in at most ``most`` values."""
    d = sketch ^ one[:, None]
    return np.bitwise_count(d[0] | d[2]) + np.bitwise_count(d[1] | d[3]) <= most


def _sketches(group: pa.Table) -> np.ndarray:
    return np.stack([group.column(c).to_numpy() for c in SKETCH]).view(np.uint64)


def _in_batches(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Edges (2 x n) as batches."""
    held: list[np.ndarray] = []
    for part in parts:
        held.append(part)
        if len(held) >= 2000:
            yield _edges(held)
            held = []
    if held:
        yield _edges(held)


def _forest_of(node: np.ndarray, classes: Linked) -> Iterator[np.ndarray]:
    """Edges from the smallest node of each class to its others: alike classes of several orders give the same edges."""
    if classes.of.any() or len(node) > 1:
        root = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(root, classes.of, node)
        root = root[classes.of]
        if (apart := root != node).any():
            yield np.stack([root[apart], node[apart]])


def _region_edges(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """For each part in its order the edges that join what the sketches do not tell apart.

    Parts of a large region also have its pivot: those that may be similar to it are joined first, and through it.
    """

    def found() -> Iterator[np.ndarray]:
        for group in _groups(batches, 1):
            node, sketch = group.column("node").to_numpy(), _sketches(group)
            if "pivot" in group.column_names:
                pivot = np.array([group.column(c)[0].as_py() for c in PIVOT[1:]], np.int64).view(np.uint64)
                node, sketch = np.append(group.column("pivot")[0].as_py(), node), np.column_stack([pivot, sketch])
            n = len(node)
            classes = Linked(n)
            if "pivot" in group.column_names:
                classes.of[_near(sketch, sketch[:, 0], most)] = 0
            d = sketch[:, 1:] ^ sketch[:, :-1]
            for k in np.flatnonzero(np.bitwise_count(d[0] | d[2]) + np.bitwise_count(d[1] | d[3]) <= most).tolist():
                classes.join(k, k + 1)
            for k in range(n - 1 if classes.of.any() else 0):
                rest = k + 1 + np.flatnonzero(classes.of[k + 1 :] != classes.of[k])
                for j in rest[_near(sketch[:, rest], sketch[:, k], most)].tolist():
                    classes.join(k, j)
            yield from _forest_of(node, classes)

    return _in_batches(found())


def _across_edges(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks the edges that join nodes of different classes, by their sketches."""

    def found() -> Iterator[np.ndarray]:
        for group in _groups(batches, 3):
            node, sketch, few = group.column("node").to_numpy(), _sketches(group), group.column("few").to_numpy(zero_copy_only=False)
            kinds, kind = np.unique(group.column("class").to_numpy(), return_inverse=True)
            classes = Linked(len(kinds))
            many = np.flatnonzero(~few)
            for i in np.flatnonzero(few).tolist():
                rest = many[classes.of[kind[many]] != classes.of[kind[i]]]
                for j in rest[_near(sketch[:, rest], sketch[:, i], most)].tolist():
                    if classes.join(kind[i], kind[j]):
                        yield np.array([[node[i]], [node[j]]])

    return _in_batches(found())


def _edges(parts: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate(parts, axis=1)
    both = both[:, both[0] != both[1]]
    return pa.record_batch([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], names=["a", "b"])


def _parts(forest: DataFrame, folder: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The forest's rows with the column ``part`` in place of their region; those of large regions apart, and uncut too.

    A part is a region of up to REGION nodes, or of a larger one the nodes with 2 or 4 further values in common; what is
    larger still is dealt into blocks. Sizes come from partial aggregations. Rows of large regions have the region's
    smallest node as its pivot.
    """
    sizes = materialise(forest.groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") > REGION), folder, "large_sizes")
    if not sizes.limit(1).count():
        return forest.withColumnRenamed("region", "part"), None, None
    rows = forest.join(sizes, "region", "left")
    large = materialise(rows.filter("n is not null").drop("n"), folder, "large_regions")
    pivots = large.groupBy("region").agg(F.min(F.struct("node", *SKETCH)).alias("p"))
    rest = large.join(pivots.select("region", *(F.col(f"p.{a}").alias(b) for a, b in zip(("node", *SKETCH), PIVOT, strict=True))), "region")
    columns, parts = ["part", "place", "node", *SKETCH, *PIVOT], None
    for values in (2, 4):
        rest = rest.withColumn("part", F.xxhash64("region", F.shiftrightunsigned("place", 64 - 16 * values), F.lit(values)))
        rest = materialise(rest.join(rest.groupBy("part").agg(F.count("*").alias("n")), "part"), folder, f"depth_{values}")
        fits = rest.filter(F.col("n") <= REGION).select(columns)
        parts = fits if parts is None else parts.unionByName(fits)
        rest = rest.filter(F.col("n") > REGION) if values == 4 else rest.filter(F.col("n") > REGION).drop("n", "part")
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / F.lit(REGION)))
    parts = parts.unionByName(rest.withColumn("part", F.xxhash64("part", block)).select(columns))
    return rows.filter("n is null").withColumnRenamed("region", "part"), parts, large


def _across(rows: DataFrame, key: str, rest: list[str], weight: str | None = None) -> DataFrame:
    """Pairs of blocks of each group of ``key`` that bring those outside its commonest class before all its rows.

    ``rows``: key, node, class and ``rest``. Returns key, few_block, many_block, few, node, class and ``rest``. Groups of one
    class give nothing. No block has much more than BLOCK rows, or BLOCK_SHINGLES of ``weight``.
    """
    heavy = F.sum(weight) if weight else F.lit(0)
    kinds = rows.groupBy(key, "class").agg(F.count("*").alias("n"), heavy.alias("w"))
    totals = kinds.groupBy(key).agg(F.max(F.struct("n", "w", "class")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w")).filter("n > top.n")
    blocks = lambda n, w: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(w / F.lit(BLOCK_SHINGLES)), F.lit(1).cast("long")).cast("int")
    split = totals.select(key, F.col("top.class").alias("common"), blocks(F.col("n"), F.col("w")).alias("many"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("some"))
    every = rows.join(split, key)
    own = lambda n: F.pmod(F.xxhash64("node", n), n.cast("long")).cast("int")
    columns = [key, "few_block", "many_block", "few", "node", "class", *rest]
    many = every.withColumns({"many_block": own(F.col("many")), "few_block": F.explode(F.sequence(F.lit(0), F.col("some") - 1)), "few": F.lit(False)})
    few = every.filter("class <> common").withColumns({"few_block": own(F.col("some")), "many_block": F.explode(F.sequence(F.lit(0), F.col("many") - 1)), "few": F.lit(True)})
    return many.select(columns).unionByName(few.select(columns))


def connected_components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """node, component (smallest node that can be reached) for the nodes of ``edges`` (a, b: long).

    Each round takes the smallest label among a node and its neighbours, then the label's label. Every round is a
    written table, and those of the round before go. Labels only fall, so the loop ends when their sum no longer changes.
    """
    spark = edges.sparkSession
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), folder, f"{name}_edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), folder, f"{name}_0")
    total, turn = None, 0
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels.select("node", F.col("label").alias("component"))
        total, turn = now, turn + 1
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("best"))
        lower = labels.join(around, labels["node"] == around["a"]).select("node", F.least("label", "best").alias("label"))
        lower = materialise(lower, folder, f"{name}_{turn}a")
        target = lower.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = lower.join(target, lower["label"] == target["at"]).select("node", F.least("label", "further").alias("label"))
        labels = materialise(jumped, folder, f"{name}_{turn}")
        for old in (f"{name}_{turn - 1}", f"{name}_{turn}a"):
            discard(spark, folder, old)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def link_classes(sets: list[np.ndarray], percent: int = PERCENT) -> Linked:
    """The classes of sets under the links between them, by exact counts.

    A set is counted against all sets that are not yet in its class, in one vectorised pass over their elements.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    classes = Linked(n)
    if n == 2:
        if similar(*sets, percent):
            classes.join(0, 1)
        return classes
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    marks = np.zeros(int(ids.max()) + 1, bool)
    for i in range(n - 1):
        fit = (np.arange(n) > i) & (classes.of != classes.of[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        others = np.flatnonzero(fit)
        if not len(others):
            continue
        own = ids[starts[i] : starts[i] + sizes[i]]
        marks[own] = True
        flat = np.concatenate([ids[starts[j] : starts[j] + sizes[j]] for j in others])
        common = np.add.reduceat(marks[flat].astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
        marks[own] = False
        for j in others[100 * common >= percent * (sizes[i] + sizes[others] - common)].tolist():
            classes.join(i, j)
    return classes


def _sets_of(group: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows of a group, one a node, whose text has the node's set, and the sets."""
    rows, sets, seen = [], [], set()
    node, digest, texts = group.column("node").to_pylist(), group.column("set_a").to_pylist(), group.column("text")
    for k in range(0, len(node), 256):
        for i, x in enumerate(shingle_sets(pc.fill_null(texts.slice(k, 256).combine_chunks(), "")), k):
            if node[i] not in seen and len(x) and int(x.sum().astype(np.int64)) == digest[i]:
                seen.add(node[i])
                rows.append(i)
                sets.append(x)
    return np.array(rows, np.int64), sets


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Confirmed edges of each block of a cluster."""

    def found() -> Iterator[np.ndarray]:
        for group in _groups(batches, 2):
            rows, sets = _sets_of(group)
            if len(rows) > 1:
                yield from _forest_of(group.column("node").to_numpy()[rows], link_classes(sets, percent))

    return _in_batches(found())


def _confirm_across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Confirmed edges between nodes of different classes of a pair of blocks."""

    def found() -> Iterator[np.ndarray]:
        for group in _groups(batches, 3):
            for few in (True, False):  # a node may be on both sides: its rows are told apart by their side
                side = group.filter(pc.equal(group.column("few"), few))
                rows, sets = _sets_of(side)
                if few:
                    own = side.take(rows), sets
                else:
                    other, others = side.take(rows), sets
            left, right = own[0].column("node").to_numpy(), other.column("node").to_numpy()
            kinds, kind = np.unique(np.concatenate([own[0].column("class").to_numpy(), other.column("class").to_numpy()]), return_inverse=True)
            classes = Linked(len(kinds))
            sizes = np.array([len(x) for x in others], np.int64)
            for i, x in enumerate(own[1]):
                fit = (classes.of[kind[len(left) :]] != classes.of[kind[i]]) & (100 * np.minimum(sizes, len(x)) >= percent * np.maximum(sizes, len(x)))
                for j in np.flatnonzero(fit).tolist():
                    a, b = kind[i], kind[len(left) + j]
                    if classes.of[a] != classes.of[b] and similar(x, others[j], percent) and classes.join(a, b):
                        yield np.array([[left[i]], [right[j]]])

    return _in_batches(found())


def _by_group(rows: DataFrame, keys: list[str], rest: list[str], run: Callable, order: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, "a long, b long")


def trees_for(percent: int) -> int:
    """Trees (4 values of the signature each) of which a pair at ``percent`` meets in one but for 1 in 100,000 pairs."""
    trees = max(TREES, math.ceil(math.log(1e-5) / math.log(1 - (percent / 100) ** SHALLOW))) if 0 < percent < 100 else TREES
    if percent <= 0 or trees * SHALLOW > TREES * DEPTH:
        raise ValueError("the signature is too short for so low a percentage")
    return trees


def most_different(percent: int) -> int:
    """Differing sketch values of 128 up to which a pair may be a link: those expected, plus 6 deviations."""
    differ = 0.75 * (1 - percent / 100)
    return math.ceil(TREES * DEPTH * differ + 6 * math.sqrt(TREES * DEPTH * differ * (1 - differ)))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate classes of whole texts, linked from ``percent`` of common shingles on.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (doc_id =
    component_id). A text without words, empty or null, has no set, is linked with nothing and is kept. Rows with a
    null doc_id are left out, since nothing could name them; rows that repeat a doc_id are one document, that of
    the smallest set digest. Ties go to the smallest id; other columns are not carried. An empty table gives an
    empty one. Equal sets are collapsed by a partial aggregation before anything is compared.
    """
    folder = shared_dir(docs.sparkSession)
    named = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(_summaries(named), folder, "summaries")
    ids = rows.groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b", "n_shingles")).alias("s")).select("doc_id", "s.*")
    nodes = rows.filter("set_a is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    nodes = materialise(nodes, folder, "nodes")
    clusters = _clusters(materialise(_forest(nodes, trees_for(percent)), folder, "forest"), most_different(percent), folder)
    classes = _classes(clusters.join(nodes.select("node", "set_a", "n_shingles"), "node"), named, percent, folder)

    final = nodes.select("set_a", "set_b", "node").join(classes, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    out = ids.join(final, ["set_a", "set_b"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def _clusters(forest: DataFrame, most: int, folder: str) -> DataFrame:
    """node, cluster: the components of what the sketches do not tell apart within a region."""
    parts, of_large, large = _parts(forest, folder)
    edges = _by_group(parts, ["part"], ["place", "node", *SKETCH], partial(_region_edges, most=most), ("place", "node"))
    if of_large is not None:
        edges = edges.unionByName(_by_group(of_large, ["part"], ["place", "node", *SKETCH, *PIVOT], partial(_region_edges, most=most), ("place", "node")))
    maybe = materialise(edges.distinct(), folder, "maybe")
    clusters = connected_components(maybe, folder, "clusters")
    if large is not None:
        kind = large.join(clusters, "node", "left").select("region", "node", F.coalesce("component", "node").alias("class"), *SKETCH)
        rest = _across(kind, "region", list(SKETCH))
        more = materialise(_by_group(rest, ["region", "few_block", "many_block"], ["few", "node", "class", *SKETCH], partial(_across_edges, most=most)).distinct(), folder, "maybe_across")
        if more.limit(1).count():
            clusters = connected_components(maybe.unionByName(more), folder, "clusters_across")
    return clusters.withColumnRenamed("component", "cluster")


def _classes(members: DataFrame, named: DataFrame, percent: int, folder: str) -> DataFrame:
    """node, component of the confirmed links within clusters. ``members``: node, cluster, set_a, n_shingles."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.ceil(F.col("w") / F.lit(BLOCK_SHINGLES)))
    dealt = materialise(members.join(sizes, "cluster").select("cluster", "node", "set_a", "n_shingles", blocks.alias("blocks")), folder, "members")
    # Members grow with the input: a shuffled join at every size, never a broadcast that only small inputs get.
    texts = lambda found: named.join(found.hint("merge"), named["doc_id"] == found["node"])

    own = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    large = dealt.filter("blocks > 1")
    pivots = large.groupBy("cluster", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(PIVOTS))).agg(F.min(F.struct("node", "set_a", "blocks")).alias("p"))
    spread = pivots.select("cluster", "p.node", "p.set_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p.blocks") - 1)).alias("block"))
    placed = own.select("cluster", "node", "set_a", "block").unionByName(spread).distinct()
    links = materialise(_by_group(texts(placed), ["cluster", "block"], ["node", "set_a", "text"], partial(_confirm, percent=percent)).distinct(), folder, "links")
    classes = connected_components(links, folder, "classes")
    if not large.limit(1).count():
        return classes
    kind = large.join(classes, "node", "left").select("cluster", "node", "set_a", "n_shingles", F.coalesce("component", "node").alias("class"))
    rest = materialise(_across(kind, "cluster", ["set_a"], "n_shingles"), folder, "across")
    more = materialise(_by_group(texts(rest), ["cluster", "few_block", "many_block"], ["few", "node", "class", "set_a", "text"], partial(_confirm_across, percent=percent)).distinct(), folder, "links_across")
    if not more.limit(1).count():
        return classes
    return connected_components(links.unionByName(more), folder, "classes_across")
