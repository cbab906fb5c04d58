"""Centres of clusters: nearest centres in Arrow batches, Lloyd steps, and first centres by k-means-parallel.

Centres are a broadcast array; a pass adds up each cluster's points within tasks, so what is shuffled and what reaches the
driver is a row a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tessera.functions.storage import cut

#: Points that meet all centres at a time.
ROWS = 2048


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first of its nearest centres, and the distance.

    One matrix product finds what may be nearest; only rows with several such centres are compared by differences.
    """
    best = np.zeros(len(x), np.int64)
    squares = (centres * centres).sum(axis=1)
    for k in range(0, len(x), ROWS):
        part = x[k : k + ROWS]
        rough = squares - 2 * (part @ centres.T)
        room = 1e-9 * ((part * part).sum(axis=1) + squares.max(initial=0.0)) + 1e-300
        near = rough <= (rough.min(axis=1) + room)[:, None]
        found = near.argmax(axis=1)
        for r in np.flatnonzero(near.sum(axis=1) > 1):
            among = np.flatnonzero(near[r])
            found[r] = among[((centres[among] - part[r]) ** 2).sum(axis=1).argmin()]
        best[k : k + ROWS] = found
    return best, np.sqrt(((x - centres[best]) ** 2).sum(axis=1))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assign(points: DataFrame, centres: dict[int, list[float]]) -> DataFrame:
    """Add cluster, the nearest centre (the smallest number of equally near ones), and its distance; rows need a vec."""
    numbers = np.array(sorted(centres), np.int32)
    held = points.sparkSession.sparkContext.broadcast(np.array([centres[int(c)] for c in numbers], np.float64))
    kept = [f for f in points.schema if f.name not in ("cluster", "distance")]
    out = StructType([*kept, StructField("cluster", IntegerType()), StructField("distance", DoubleType())])
    at = [f.name for f in kept].index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, d = nearest_centre(_vectors(batch.column(at)), held.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers[best]), pa.array(d)], names=[f.name for f in out])

    return points.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, out)


def cluster_means(points: DataFrame, centres: dict[int, list[float]]) -> dict[int, tuple[int, list[float]]]:
    """The number and the mean of the points nearest to each centre, of centres that have any."""
    numbers = sorted(centres)
    held = points.sparkSession.sparkContext.broadcast(np.array([centres[c] for c in numbers], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        n, sums = np.zeros(len(c), np.int64), np.zeros_like(c)
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(0))
                best, _ = nearest_centre(x, c)
                n += np.bincount(best, minlength=len(c))
                order = np.argsort(best, kind="stable")
                first = np.flatnonzero(np.diff(best[order], prepend=-1))
                sums[best[order][first]] += np.add.reduceat(x[order], first, axis=0)
        there = np.flatnonzero(n)
        yield pa.record_batch([pa.array(there.astype(np.int32)), pa.array(n[there]), pa.array([sums[k].tobytes() for k in there], pa.binary())], names=["cluster", "n", "sums"])

    def add(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table([table.column("cluster")[:1], pa.array([sum(table.column("n").to_pylist())], pa.int64()), pa.array([whole.tobytes()], pa.binary())], names=["cluster", "n", "sums"])

    schema = "cluster int, n long, sums binary"
    found = points.select("vec").mapInArrow(run, schema).groupBy("cluster").applyInArrow(add, schema).collect()  # a row a cluster
    return {numbers[r["cluster"]]: (r["n"], (np.frombuffer(r["sums"]) / r["n"]).tolist()) for r in found}


def weighted_centres(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Centres of weighted points on one machine: k-means++ draws by weight and squared distance, then Lloyd rounds."""
    rng = np.random.default_rng(seed)
    if not len(x) or not weight.sum():
        return x[:0]
    chosen = [int(rng.choice(len(x), p=weight / weight.sum()))]
    d = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and (weight * d).sum() > 0:
        # of a few draws the one that leaves the least cost
        tries = rng.choice(len(x), size=2 + int(np.log(k)), p=weight * d / (weight * d).sum())
        left = [np.minimum(d, ((x - x[t]) ** 2).sum(axis=1)) for t in tries]
        best = int(np.argmin([(weight * v).sum() for v in left]))
        chosen.append(int(tries[best]))
        d = left[best]
    centres = x[chosen].copy()
    for _ in range(rounds):
        at, _ = nearest_centre(x, centres)
        total = np.bincount(at, weight, len(centres))
        moved = np.stack([np.bincount(at, weight * x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        fresh = np.where(total[:, None] > 0, moved / np.maximum(total, 1e-300)[:, None], centres)
        if np.allclose(fresh, centres):
            break
        centres = fresh
    return centres


def parallel_centres(points: DataFrame, k: int, rounds: int = 5, oversample: float = 2.0, seed: int = 7) -> DataFrame:
    """cluster, vec: first centres by k-means-parallel; points: id, vec.

    Each round draws about ``oversample * k`` points at once, each with a chance in proportion to its squared distance from
    those drawn before; the candidates, at most some multiples of ``rounds * oversample * k``, are weighed by the points
    nearest to them and clustered on the driver. The passes do not depend on ``k``. Points that are alike give one centre.
    """
    u = lambda turn: (F.pmod(F.xxhash64("id", F.lit(seed * 1009 + turn)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    first = points.select("id", "vec").filter("vec is not null").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).collect()
    if not first:
        return points.sparkSession.createDataFrame([], "cluster int, vec array<double>")
    found = [list(map(float, first[0]["vec"]))]
    rows = points.select("id", "vec").filter("vec is not null")
    for turn in range(rounds):
        fresh = dict(enumerate(found if turn == 0 else newest))
        near = assign(rows, fresh).drop("cluster") if turn == 0 else assign(rows.withColumnRenamed("distance", "_d"), fresh).withColumn("distance", F.least("distance", "_d")).drop("_d", "cluster")
        rows = cut(near)
        cost = rows.agg(F.sum(F.col("distance") * F.col("distance"))).first()[0]
        if not cost:
            break
        chance = oversample * k * F.col("distance") * F.col("distance") / cost
        newest = [list(map(float, r["vec"])) for r in rows.filter(u(turn) < chance).select("vec").collect()]  # about oversample * k rows
        found += newest
        if not newest:
            newest = found[:1]
    distinct = np.unique(np.array(found), axis=0)
    weights = {c: n for c, (n, _) in cluster_means(rows, dict(enumerate(distinct.tolist()))).items()}
    made = weighted_centres(distinct, np.array([weights.get(c, 0) for c in range(len(distinct))], np.float64), k, seed=seed)
    return points.sparkSession.createDataFrame(list(enumerate(made.tolist())), "cluster int, vec array<double>")


def cost(points: DataFrame, centres: dict[int, list[float]]) -> float:
    """The sum of squared distances to the nearest centres."""
    return float(assign(points.filter("vec is not null"), centres).agg(F.sum(F.col("distance") * F.col("distance"))).first()[0] or 0.0)
