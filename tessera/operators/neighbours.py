"""Nearest neighbours by metric trees, exactly.

A bounded sample of the points makes a tree on the driver; its leaves are the parts that points and queries are dealt
to. A query first meets the points of its own leaf, which bounds the distance of its k-th neighbour, and then goes on
only to leaves whose ball, and whose side of every cut, may hold a point within that distance. Inside a task a part's points have a tree of their own: near a
cut points stand on both sides as long as the sides stay small enough (a spill tree), so that the leaf where a query lands
bounds it well, and the exact search then opens the leaves whose balls meet the bound. Leaves with many points or many
queries are dealt into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.storage import cut

#: Points of a part, about, and at most so many parts; sampled points for each part (what reaches the driver).
PART, MOST_PARTS, SAMPLED = 4000, 8192, 10
#: Points and queries that meet in one task.
MOST_POINTS, MOST_QUERIES = 16_000, 4000
#: Points of a leaf inside a task. Points within this share of a cut's spread stand on both sides, unless a side then
#: holds more than BALANCE of all.
LEAF, SPILL, BALANCE = 64, 0.1, 0.7


@dataclass
class Tree:
    """Cuts by planes: node -> plane, threshold and children, or a leaf's number; and each leaf's members."""

    planes: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    leaves: list[int] = field(default_factory=list)
    #: The members of each leaf, and with those beyond its cuts' edges.
    members: list[np.ndarray] = field(default_factory=list)
    spilled: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def grow(x: np.ndarray, leaf: int, spill: float = 0.0) -> Tree:
        tree = Tree()
        tree._node(x, np.arange(len(x)), np.arange(len(x)), leaf, spill)
        return tree

    def _node(self, x: np.ndarray, own: np.ndarray, wide: np.ndarray, leaf: int, spill: float) -> int:
        at = len(self.planes)
        self.planes.append(np.zeros(x.shape[1]))
        self.thresholds.append(0.0)
        self.children.append((-1, -1))
        self.leaves.append(-1)
        if len(own) > leaf:
            middle = x[own].mean(axis=0)
            a = x[own[((x[own] - middle) ** 2).sum(axis=1).argmax()]]
            b = x[own[((x[own] - a) ** 2).sum(axis=1).argmax()]]
            along = x[own] @ (b - a)
            threshold = _gap(np.sort(along))
            left = along <= threshold
            if left.any() and not left.all():
                reach = x[wide] @ (b - a)
                edge = spill * float(along.max() - along.min())
                wide_left, wide_right = wide[reach <= threshold + edge], wide[reach > threshold - edge]
                if max(len(wide_left), len(wide_right)) > BALANCE * len(wide):
                    wide_left, wide_right = wide[reach <= threshold], wide[reach > threshold]
                self.planes[at], self.thresholds[at] = b - a, threshold
                self.children[at] = (self._node(x, own[left], wide_left, leaf, spill), self._node(x, own[~left], wide_right, leaf, spill))
                return at
        self.leaves[at] = len(self.members)
        self.members.append(own)
        self.spilled.append(wide)
        return at

    def beyond(self, q: np.ndarray) -> np.ndarray:
        """How far at least each row of ``q`` is from each leaf, by the cuts between them (a little less, for rounding)."""
        out = np.zeros((len(q), len(self.members)))
        work = [(0, np.zeros(len(q)))]
        while work:
            node, least = work.pop()
            if self.leaves[node] >= 0:
                out[:, self.leaves[node]] = least
                continue
            length = max(float(np.sqrt((self.planes[node] ** 2).sum())), 1e-300)
            side = (q @ self.planes[node] - self.thresholds[node]) / length
            room = 1e-9 * (np.abs(side) + abs(self.thresholds[node]) / length)
            work += [(self.children[node][0], np.maximum(least, side - room)), (self.children[node][1], np.maximum(least, -side - room))]
        return out

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into."""
        out = np.zeros(len(x), np.int64)
        work = [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if self.leaves[node] >= 0:
                out[rows] = self.leaves[node]
            elif len(rows):
                left = x[rows] @ self.planes[node] <= self.thresholds[node]
                work += [(self.children[node][0], rows[left]), (self.children[node][1], rows[~left])]
        return out


def _gap(along: np.ndarray) -> float:
    """Where to cut sorted values: in the widest gap of their middle, or else of all; their end if they are all alike."""
    gaps = np.diff(along)
    low, high = int(0.3 * len(gaps)), max(int(0.7 * len(gaps)), int(0.3 * len(gaps)) + 1)
    k = low + int(gaps[low:high].argmax())
    if gaps[k] <= 0:
        k = int(gaps.argmax())
    middle = float(along[k] + gaps[k] / 2)
    return middle if along[k] <= middle < along[k + 1] else float(along[k])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of each row of ``x`` to each of ``y``, by differences, some rows at a time."""
    out = np.empty((len(x), len(y)))
    step = max(1, (4 << 20) // max(1, y.size))
    for k in range(0, len(x), step):
        d = x[k : k + step, None, :] - y[None, :, :]
        out[k : k + step] = np.sqrt(np.einsum("abc,abc->ab", d, d))
    return out


def _least(distances: np.ndarray, k: int) -> np.ndarray:
    """The k-th least distance of each row; infinite if there are fewer."""
    if distances.shape[1] < k:
        return np.full(len(distances), np.inf)
    return np.partition(distances, k - 1, axis=1)[:, k - 1]


def _meets(centre_distance: np.ndarray, radius: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Whether a ball may hold a point within ``bound``, with room for rounding."""
    return centre_distance - radius <= bound * (1 + 1e-9) + 1e-12 * (1 + centre_distance)


class Searched:
    """The points of a block under a tree of their own."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.tree = ids, x, Tree.grow(x, LEAF, SPILL)
        self.centres = np.array([x[m].mean(axis=0) for m in self.tree.members])
        self.radii = np.array([np.sqrt(((x[m] - c) ** 2).sum(axis=1)).max() for m, c in zip(self.tree.members, self.centres, strict=True)])

    def bounds(self, own: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """For each query an upper bound of its k-th neighbour's distance: that in the leaf where it lands, spilled points included."""
        out, home = np.full(len(q), np.inf), self.tree.route(q)
        for leaf in np.unique(home):
            rows = np.flatnonzero(home == leaf)
            there = self.tree.spilled[leaf]
            d = _apart(q[rows], self.x[there])
            d[self.ids[there][None, :] == own[rows][:, None]] = np.inf
            out[rows] = _least(d, k)
        return out

    def search(self, own: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query row, neighbour and distance of each query's k nearest within ``bound``, of equally near ones the least ids."""
        bound = np.minimum(bound, self.bounds(own, q, k))
        apart, beyond = _apart(q, self.centres), self.tree.beyond(q)
        best, who = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        for leaf in np.argsort(apart.mean(axis=0)):
            within = np.minimum(bound, best[:, -1])
            rows = np.flatnonzero(_meets(apart[:, leaf], self.radii[leaf], within) & (beyond[:, leaf] <= within))
            if not len(rows):
                continue
            there = self.tree.members[leaf]
            d = _apart(q[rows], self.x[there])
            d[(self.ids[there][None, :] == own[rows][:, None]) | (d > bound[rows][:, None])] = np.inf
            d = np.concatenate([best[rows], d], axis=1)
            i = np.concatenate([who[rows], np.broadcast_to(self.ids[there], (len(rows), len(there)))], axis=1)
            order = np.lexsort((i, d), axis=-1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(d, order, axis=1), np.take_along_axis(i, order, axis=1)
        row, place = np.nonzero(np.isfinite(best))
        return row, who[row, place], best[row, place]


def _stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Index:
    """Points dealt into the leaves of a top tree.

    points: id long, vec array<double>, all of one length. Rows whose id or vector is null, or whose vector holds a null or
    NaN, are left out. ``parts`` is the number of leaves; by default one for every PART points, up to MOST_PARTS.
    """

    def __init__(self, points: DataFrame, parts: int | None = None):
        points = points.select("id", "vec").filter("id is not null and vec is not null and not exists(vec, x -> x is null or isnan(x))")
        self.parts = parts or min(MOST_PARTS, max(1, -(-points.count() // PART)))
        sample = points.orderBy(F.xxhash64("id"), "id").limit(SAMPLED * self.parts).select("vec").toArrow()
        x = _stacked(sample.column("vec"))
        self.tree = tree = Tree.grow(x, -(-len(x) // self.parts)) if len(x) else Tree.grow(np.zeros((1, 0)), 1)
        self.centres = centres = np.array([x[m].mean(axis=0) for m in tree.members]) if len(x) else np.zeros((1, 0))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = _stacked(batch.column("vec"))
                    leaf = tree.route(v)
                    far = np.sqrt(((v - centres[leaf]) ** 2).sum(axis=1)) if centres.size else np.zeros(len(v))  # without points there are no centres
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(leaf.astype(np.int32)), pa.array(far)], names=["id", "vec", "leaf", "far"])

        self.deal = lambda df: df.mapInArrow(deal, "id long, vec array<double>, leaf int, far double")
        self.points = cut(self.deal(points))
        balls = self.points.groupBy("leaf").agg(F.max("far").alias("far"), F.count("*").alias("n")).toArrow()  # a row a leaf
        self.radii, self.sizes = np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
        self.radii[balls.column("leaf").to_numpy()] = balls.column("far").to_numpy()
        self.sizes[balls.column("leaf").to_numpy()] = balls.column("n").to_numpy()

    def _met(self, asked: DataFrame, k: int, first: bool) -> DataFrame:
        """Queries (id, vec, bound, leaf) with the points of their leaves, a block of each at a time."""
        spark = asked.sparkSession
        counts = {r["leaf"]: r["n"] for r in asked.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
        rows = [(leaf, max(1, -(-int(self.sizes[leaf]) // MOST_POINTS)), -(-n // MOST_QUERIES)) for leaf, n in counts.items()]
        shape = F.broadcast(spark.createDataFrame(rows, "leaf int, of_points int, of_queries int"))  # at most MOST_PARTS rows
        own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        there = self.points.join(shape, "leaf").select("leaf", own("of_points").alias("block"), "id", "vec", each("of_queries").alias("asked"))
        here = asked.join(shape, "leaf").select("leaf", own("of_queries").alias("asked"), "id", "vec", "bound", each("of_points").alias("block"))
        key = ["leaf", "block", "asked"]

        def run(asked: pa.Table, held: pa.Table) -> pa.Table:
            row, who, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            own = asked.column("id").to_numpy()
            if held.num_rows and asked.num_rows:
                searched = Searched(held.column("id").to_numpy(), _stacked(held.column("vec")))
                q = _stacked(asked.column("vec"))
                if first:
                    d = searched.bounds(own, q, k)
                    row = np.arange(len(q))
                    who = own
                else:
                    row, who, d = searched.search(own, q, asked.column("bound").to_numpy(), k)
            return pa.table([pa.array(own[row]), pa.array(who), pa.array(d)], names=["query", "neighbour", "distance"])

        return here.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(run, "query long, neighbour long, distance double")

    def routed(self, queries: DataFrame, k: int, max_distance: float | None = None) -> DataFrame:
        """id, vec, bound, leaf: a row for each leaf that a query must meet."""
        most = float("inf") if max_distance is None else float(max_distance)
        queries = queries.select("id", "vec").filter("id is not null and vec is not null and not exists(vec, x -> x is null or isnan(x))")
        home = cut(self.deal(queries).select("id", "vec", F.lit(most).alias("bound"), "leaf"))
        bounds = self._met(home, k, first=True).groupBy(F.col("query").alias("id")).agg(F.least(F.min("distance"), F.lit(most)).alias("bound"))
        centres, radii, tree = self.centres, self.radii, self.tree

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    q, bound = _stacked(batch.column("vec")), batch.column("bound").to_numpy()[:, None]
                    meets = _meets(_apart(q, centres), radii[None, :], bound) & (tree.beyond(q) <= bound) if centres.size else np.zeros((len(q), 1), bool)
                    row, leaf = np.nonzero(meets)
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(leaf.astype(np.int32))], names=["id", "vec", "bound", "leaf"])

        bounded = home.drop("bound", "leaf").join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(most)))
        return cut(bounded.mapInArrow(spread, "id long, vec array<double>, bound double, leaf int"))

    def nearest(self, queries: DataFrame, k: int, max_distance: float | None = None) -> DataFrame:
        near = self._met(self.routed(queries, k, max_distance), k, first=False)
        place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
        return near.withColumn("place", place).filter(F.col("place") <= k)


def nearest(points: DataFrame, queries: DataFrame, k: int, max_distance: float | None = None) -> DataFrame:
    """query, neighbour, distance, place: the k nearest by distance, then id, none its own, none beyond ``max_distance``.

    points, queries: id long, vec array<double>; a query's id stands once. A query without neighbours, or with a null or NaN
    in its vector, has no row.
    """
    return Index(points).nearest(queries, k, max_distance)


def with_neighbours(queries: DataFrame, near: DataFrame) -> DataFrame:
    """Add the arrays neighbours and distances, nearest first, empty where there are none. ``near`` is from ``nearest``."""
    lists = near.groupBy(F.col("query").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "neighbour", "distance"))).alias("_near"))
    found = queries.join(lists, "id", "left")
    arrays = {"neighbours": F.coalesce(F.col("_near.neighbour"), F.array().cast("array<bigint>")), "distances": F.coalesce(F.col("_near.distance"), F.array().cast("array<double>"))}
    return found.withColumns(arrays).drop("_near")


def vote(near: DataFrame, known: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """query, label, share: the label with the most weight among a query's neighbours, of equal ones the smallest.

    known: id, the label and, if named, the weights. Neighbours with a null label or weight do not vote.
    """
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    joined = near.join(known.select(F.col("id").alias("neighbour"), F.col(f"`{label}`").alias("_label"), w.alias("_w")), "neighbour").filter("_label is not null and _w is not null")
    votes = joined.groupBy("query", "_label").agg(F.sum("_w").alias("n"))
    place = Window.partitionBy("query").orderBy(F.desc("n"), "_label")
    shares = votes.withColumns({"share": F.try_divide("n", F.sum("n").over(Window.partitionBy("query"))), "_p": F.row_number().over(place)})
    return shares.filter("_p = 1").select("query", F.col("_label").alias("label"), "share")


def weighted_mean(near: DataFrame, known: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """query, value: the neighbours' values by their weights, the sum of w y over that of w; nulls are left out."""
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    y = F.col(f"`{value}`").cast("double")
    joined = near.join(known.select(F.col("id").alias("neighbour"), y.alias("_y"), w.alias("_w")), "neighbour").filter("_y is not null and _w is not null")
    return joined.groupBy("query").agg(F.try_divide(F.sum(F.col("_w") * F.col("_y")), F.sum("_w")).alias("value"))
