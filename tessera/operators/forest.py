"""Decision trees and random forests, all trees grown together.

Rows are written once as bins. A level is one or a few passes: a task adds up what the labels of its rows come to by tree,
node, feature and bin with NumPy, Spark adds the tasks' sums, and the best split of a node and feature is found where
its sums meet, so that one row a node reaches the driver, which holds the trees. Categories are ordered by their labels
inside the node, or all subsets tried where they are few and the classes more than two.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tessera.functions import sketch
from tessera.functions.storage import cut

#: Numbers that a task keeps for one pass: nodes x features x bins x label sums.
CELLS = 1 << 23
#: Categories of one node and feature up to which all subsets are tried when there are more than two classes.
SUBSETS = 10
#: Classes of a label.
CLASSES = 1000


@dataclass
class Params:
    trees: int = 20
    depth: int = 5
    bins: int = 32
    #: gini or entropy for classes, variance for numbers.
    impurity: str = "gini"
    min_rows: float = 1.0
    min_gain: float = 0.0
    #: Rows of a tree: with replacement each counts a Poisson number of times with this mean, else this share of them once.
    subsample: float = 1.0
    replacement: bool = True
    #: Features that a node may split on: all, sqrt, log2, third, or a share up to 1.
    subset: str | float = "sqrt"
    seed: int = 7


#: One tree of all rows and all features.
SINGLE = {"trees": 1, "replacement": False, "subset": "all"}


def bag_weights(u: np.ndarray, tree: int, p: Params) -> np.ndarray:
    """How often each row, known by the hash ``u``, counts in a tree; alike in every pass and run."""
    if not p.replacement and p.subsample >= 1:
        return np.ones(len(u))
    with np.errstate(over="ignore"):
        x = (u.astype(np.uint64) ^ np.uint64(p.seed * 1_000_003 + tree)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    draw = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    if not p.replacement:
        return (draw < p.subsample).astype(np.float64)
    chances = [math.exp(-p.subsample)]
    while chances[-1] > 1e-17 or len(chances) <= p.subsample:
        chances.append(chances[-1] * p.subsample / len(chances))
    return np.searchsorted(np.cumsum(chances), draw, "right").astype(np.float64)


def bagged(df: DataFrame, id: str, p: Params) -> DataFrame:
    """Add ``bag``: for each tree how often the row counts. Rows of one id count alike."""
    if "bag" in df.columns:
        raise ValueError("the column bag is there already")
    rows = df.withColumn("bag", F.xxhash64(F.col(f"`{id}`")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 1
            w = np.column_stack([bag_weights(batch.column(k).to_numpy(), t, p) for t in range(p.trees)])
            yield batch.set_column(k, "bag", pa.array(list(w), pa.list_(pa.float64())))

    return rows.mapInArrow(run, StructType([*df.schema.fields, StructField("bag", ArrayType(DoubleType()))]))


def node_features(n: int, tree: int, node: int, p: Params) -> np.ndarray:
    """The features, in order, that a node may split on."""
    if p.subset == "all":
        return np.arange(n)
    share = {"sqrt": math.sqrt(n), "log2": math.log2(n) if n > 1 else 1, "third": n / 3}.get(p.subset) if isinstance(p.subset, str) else p.subset * n
    m = min(n, max(1, math.ceil(share)))
    return np.sort(np.random.default_rng([p.seed, tree, node]).choice(n, m, replace=False))


def spread(s: np.ndarray, impurity: str) -> np.ndarray:
    """Impurity times weight of label sums (last axis: classes, or weight, sum and sum of squares)."""
    if impurity == "variance":
        w = s[..., 0]
        return np.where(w > 0, np.maximum(s[..., 2] - s[..., 1] ** 2 / np.where(w > 0, w, 1), 0.0), 0.0)
    n = s.sum(-1)
    share = s / np.where(n > 0, n, 1)[..., None]
    if impurity == "gini":
        return n * (1 - (share * share).sum(-1)) * (n > 0)
    return -n * (share * np.log2(np.where(share > 0, share, 1))).sum(-1)


def weight_of(s: np.ndarray, impurity: str) -> np.ndarray:
    return s[..., 0] if impurity == "variance" else s.sum(-1)


def category_order(sums: np.ndarray, impurity: str) -> np.ndarray:
    """Categories by mean label or share of the second class; of more classes, along the shares' principal direction."""
    n = weight_of(sums, impurity)
    if impurity == "variance":
        return np.argsort(sums[:, 1] / n, kind="stable")
    share = sums / n[:, None]
    if sums.shape[1] == 2:
        return np.argsort(share[:, 1], kind="stable")
    apart = share - sums.sum(0) / n.sum()
    _, vectors = np.linalg.eigh((apart * n[:, None]).T @ apart)
    return np.argsort(apart @ vectors[:, -1], kind="stable")


def best_split(codes: np.ndarray, sums: np.ndarray, category: bool, p: Params) -> tuple[float, np.ndarray, np.ndarray]:
    """Gain, the codes that go left and their sums, from the sums (a row a code) of one node and feature; gain -1 if none."""
    all_of, c = sums.sum(0), len(codes)
    none = (-1.0, codes[:0], np.zeros_like(all_of))
    if c < 2:
        return none
    if category and p.impurity != "variance" and sums.shape[1] > 2 and c <= SUBSETS:
        sides = (np.arange(1, 1 << (c - 1))[:, None] >> np.arange(c)) & 1 == 1
    else:
        order = category_order(sums, p.impurity) if category else np.argsort(codes)
        place = np.empty(c, np.int64)
        place[order] = np.arange(c)
        sides = place[None, :] <= np.arange(c - 1)[:, None]
    left = sides.astype(np.float64) @ sums
    right = all_of - left
    n = weight_of(all_of, p.impurity)
    better = (spread(all_of, p.impurity) - spread(left, p.impurity) - spread(right, p.impurity)) / n
    few = (weight_of(left, p.impurity) < p.min_rows) | (weight_of(right, p.impurity) < p.min_rows)
    better = np.where(few, -1.0, better)
    at = int(better.argmax())
    if better[at] <= max(p.min_gain, 1e-12):
        return none
    return float(better[at]), codes[sides[at]], left[at]


def _codes(batch: pa.RecordBatch, spec: list[tuple[str, list]]) -> np.ndarray:
    """Bins of the columns f0, f1, ...: 0 for a missing value or an unknown category."""
    out = np.zeros((batch.num_rows, len(spec)), np.int16)
    for k, (kind, values) in enumerate(spec):
        column = batch.column(batch.schema.get_field_index(f"f{k}"))
        if kind == "category":
            out[:, k] = pc.fill_null(pc.index_in(column, pa.array(values, pa.string())), -1).to_numpy(zero_copy_only=False) + 1
        else:
            x = column.to_numpy(zero_copy_only=False).astype(np.float64)
            out[:, k] = np.where(np.isnan(x), 0, np.searchsorted(np.array(values), x, "left") + 1)
    return out


def _read(df: DataFrame, features: list[str], spec: list[tuple[str, list]]) -> list:
    return [F.col(f"`{f}`").cast("string" if kind == "category" else "double").alias(f"f{k}") for k, (f, (kind, _)) in enumerate(zip(features, spec, strict=True))]


def _bins(df: DataFrame, features: list[str], categories: set[str], p: Params) -> list[tuple[str, list]]:
    """For each feature its kind and its cuts or categories. No more categories than bins are taken."""
    numbers = [f for f in features if f not in categories]
    rows = df.select(*(F.col(f"`{f}`").cast("double").alias(f"f{k}") for k, f in enumerate(numbers)))
    made = sketch.summaries(rows, rows.columns, lambda batch: np.ones(batch.num_rows), min(0.01, 0.25 / p.bins)) if numbers else []
    cuts = {f: sketch.cuts(s, p.bins) for f, s in zip(numbers, made, strict=True)}
    spec: list[tuple[str, list]] = []
    for f in features:
        if f not in categories:
            spec.append(("number", cuts[f]))
            continue
        found = [r[0] for r in df.select(F.col(f"`{f}`").cast("string").alias("c")).filter("c is not null").distinct().limit(p.bins + 1).collect()]
        if len(found) > p.bins:
            raise ValueError(f"{f} has more categories than bins ({p.bins})")
        spec.append(("category", sorted(found)))
    return spec


class _Tree:
    """A tree as arrays; ``left_of`` says for each node and bin whether a row goes left."""

    def __init__(self, nodes: list[dict], width: int):
        self.feature = np.array([n.get("feature", -1) for n in nodes])
        self.left, self.right = (np.array([n.get(c, 0) for n in nodes]) for c in ("left", "right"))
        self.left_of = np.zeros((len(nodes), width), bool)
        for k, n in enumerate(nodes):
            self.left_of[k, n.get("codes", [])] = True
        self.depth = max(n["depth"] for n in nodes)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        node, each = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[node]
            left = self.left_of[node, bins[each, np.maximum(f, 0)]]
            node = np.where(f < 0, node, np.where(left, self.left[node], self.right[node]))
        return node


def _splits(rows: DataFrame, trees: list[_Tree], slots: list[dict[int, int]], drawn: list[np.ndarray], spec: list[tuple[str, list]], width: int, stats: int, p: Params) -> dict[int, dict]:
    """The best split and the label sums of each slot (slots: for each tree its open nodes and their slots), in one pass."""
    n, total, tried = len(spec), len(drawn), len(drawn[0])
    chosen = np.array(drawn)
    category = np.array([kind == "category" for kind, _ in spec])
    names = [f"s{k}" for k in range(stats)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((tried, total * width, stats))
        for batch in batches:
            bins = np.column_stack([batch.column(f"b{k}").to_numpy() for k in range(n)])
            y, u = batch.column("y").to_numpy(), batch.column("u").to_numpy()
            for t, own in enumerate(slots):
                if not own:
                    continue
                table = np.full(len(trees[t].feature), -1)
                table[list(own)] = list(own.values())
                slot, w = table[trees[t].nodes(bins)], bag_weights(u, t, p)
                at = np.flatnonzero((slot >= 0) & (w > 0))
                slot, w = slot[at], w[at]
                for j in range(tried):
                    key = slot * width + bins[at, chosen[slot, j]]
                    if p.impurity == "variance":
                        for k, x in enumerate((w, w * y[at], w * y[at] ** 2)):
                            held[j, :, k] += np.bincount(key, x, total * width)
                    else:
                        held[j] += np.bincount(key * stats + y[at].astype(np.int64), w, total * width * stats).reshape(-1, stats)
        j, key = np.nonzero(held.any(-1))
        columns = [key // width, chosen[key // width, j], key % width]
        yield pa.record_batch([*(pa.array(c.astype(np.int32)) for c in columns), *(pa.array(held[j, key, k]) for k in range(stats))], names=["slot", "feature", "bin", *names])

    def best(table: pa.Table) -> pa.Table:
        feature = table.column("feature")[0].as_py()
        sums = np.column_stack([table.column(c).to_numpy() for c in names])
        codes = table.column("bin").to_numpy()
        order = np.argsort(codes)
        gain, left, part = best_split(codes[order], sums[order], bool(category[feature]), p)
        out = [table.column("slot")[:1], table.column("feature")[:1], [gain], [left.tolist()], [part.tolist()], [sums[order].sum(0).tolist()]]
        return pa.table(out, schema=pa.schema([("slot", pa.int32()), ("feature", pa.int32()), ("gain", pa.float64()), ("codes", pa.list_(pa.int32())), ("part", pa.list_(pa.float64())), ("whole", pa.list_(pa.float64()))]))

    sums = rows.mapInArrow(run, "slot int, feature int, bin int, " + ", ".join(f"{c} double" for c in names))
    sums = sums.groupBy("slot", "feature", "bin").agg(*(F.sum(c).alias(c) for c in names))
    found = sums.groupBy("slot", "feature").applyInArrow(best, "slot int, feature int, gain double, codes array<int>, part array<double>, whole array<double>")
    one = found.groupBy("slot").agg(F.max_by(F.struct("feature", "gain", "codes", "part", "whole"), F.struct(F.round("gain", 12), -F.col("feature"))).alias("b"))
    return {r["slot"]: r["b"].asDict() for r in one.collect()}


def grow(df: DataFrame, features: list[str], label: str, id: str, params: Params | None = None, categories: tuple[str, ...] = ()) -> Forest:
    """A forest of trees on numeric columns and the columns of ``categories``; ``id`` fixes a row's weights in the trees.

    Rows without a label (null or NaN) are left out. A missing number is less than all others; a missing category is a
    category of its own, and so is, at prediction, one not seen here. Rows that repeat an id count alike. Without rows
    all trees are empty and predict null. More categories than bins, or more than CLASSES classes, are refused.
    """
    p = params or Params()
    counted = p.impurity != "variance"
    y = F.col(f"`{label}`")
    known = df.filter(y.isNotNull() & (F.lit(True) if counted else ~F.isnan(y.cast("double"))))
    spec = _bins(known, features, set(categories), p)
    if counted:
        classes = sorted(r[0] for r in known.select(y.cast("string")).distinct().limit(CLASSES + 1).collect())
        if len(classes) > CLASSES:
            raise ValueError(f"{label} has more than {CLASSES} classes")
        middle, value = 0.0, (F.array_position(F.array(*map(F.lit, classes)), y.cast("string")) - 1 if classes else F.lit(0)).cast("double")
    else:
        classes, middle = [], known.agg(F.avg(y.cast("double"))).first()[0] or 0.0
        value = y.cast("double") - middle
    width, stats = max([len(v) for _, v in spec], default=0) + 2, len(classes) if counted else 3
    model = Forest(p, features, spec, classes, middle, [[{"depth": 0}] for _ in range(p.trees)])
    if stats == 0 or not features:
        return model

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes(batch, spec)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("y"), *(pa.array(codes[:, k]) for k in range(len(spec)))], names=["u", "y", *(f"b{k}" for k in range(len(spec)))])

    rows = cut(known.select(F.xxhash64(F.col(f"`{id}`")).alias("u"), value.alias("y"), *_read(known, features, spec)).mapInArrow(binned, "u long, y double, " + ", ".join(f"b{k} short" for k in range(len(spec)))))
    open_nodes = [(t, 0) for t in range(p.trees)]
    while open_nodes:
        drawn = [node_features(len(features), t, i, p) for t, i in open_nodes]
        size = max(1, CELLS // (len(drawn[0]) * width * stats))
        found: dict[int, dict] = {}
        for first in range(0, len(open_nodes), size):
            slots: list[dict[int, int]] = [{} for _ in range(p.trees)]
            for slot, (t, i) in enumerate(open_nodes[first : first + size]):
                slots[t][i] = slot
            got = _splits(rows, [_Tree(nodes, width) for nodes in model.trees], slots, drawn[first : first + size], spec, width, stats, p)
            found |= {first + slot: b for slot, b in got.items()}
        later = []
        for slot, b in sorted(found.items()):
            t, i = open_nodes[slot]
            nodes, node = model.trees[t], model.trees[t][open_nodes[slot][1]]
            node["sums"] = b["whole"]
            if b["gain"] <= 0 or node["depth"] >= p.depth:
                continue
            feature = b["feature"]
            codes = b["codes"] if spec[feature][0] == "category" else list(range(max(b["codes"]) + 1))
            node |= {"feature": feature, "codes": codes, "gain": b["gain"], "left": len(nodes), "right": len(nodes) + 1}
            for part in (b["part"], (np.array(b["whole"]) - b["part"]).tolist()):
                child = {"depth": node["depth"] + 1, "sums": part}
                s = np.array(part)
                n = float(weight_of(s, p.impurity))
                if child["depth"] < p.depth and n >= 2 * p.min_rows and float(spread(s, p.impurity)) > 1e-12 * n:
                    later.append((t, len(nodes)))
                nodes.append(child)
        open_nodes = later
    return model


@dataclass
class Forest:
    params: Params
    features: list[str]
    #: For each feature its kind and its cuts or categories.
    spec: list[tuple[str, list]]
    classes: list[str]
    middle: float
    trees: list[list[dict]]

    def _value(self, node: dict) -> list[float]:
        s = np.array(node["sums"])
        return [self.middle + float(s[1] / s[0])] if self.params.impurity == "variance" else (s / s.sum()).tolist()

    def predict(self, df: DataFrame, leaves: bool = False) -> DataFrame:
        """Add ``prediction`` (a class as text, or a number) and ``shares`` (of the classes; without them the number).

        Trees count alike, each by the shares or the mean of its leaf; of equal classes the first in order wins. With
        ``leaves`` also ``leaves``, the node that each tree reaches. Columns of these names must not be there already.
        """
        added = ["prediction", "shares", *(["leaves"] if leaves else [])]
        if set(added) & {c.lower() for c in df.columns}:
            raise ValueError(f"the columns {added} are added here")
        width = max([len(v) for _, v in self.spec], default=0) + 2
        own = [nodes for nodes in self.trees if "sums" in nodes[0]]
        trees, values = [_Tree(nodes, width) for nodes in own], [np.array([self._value(n) for n in nodes]) for nodes in own]
        spec, classes, n = self.spec, np.array(self.classes, object), len(self.features)
        rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *_read(df, self.features, self.spec))
        fields = [StructField("shares", ArrayType(DoubleType())), StructField("prediction", df.sparkSession.range(0).select(F.lit("").alias("x") if len(classes) else F.lit(0.0).alias("x")).schema[0].dataType)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = _codes(batch, spec) if n else np.zeros((batch.num_rows, 1), np.int16)
                at = [t.nodes(bins) for t in trees]
                if trees:
                    share = sum(v[i] for v, i in zip(values, at, strict=True)) / len(trees)
                    shares = pa.array(list(share), pa.list_(pa.float64()))
                    said = pa.array(classes[share.argmax(1)].tolist(), pa.string()) if len(classes) else pa.array(share[:, 0])
                else:
                    shares = pa.nulls(batch.num_rows, pa.list_(pa.float64()))
                    said = pa.nulls(batch.num_rows, pa.string() if len(classes) else pa.float64())
                out = [batch.column("row"), shares, said]
                if leaves:
                    out.append(pa.array(list(np.column_stack(at).astype(np.int32)) if at else [[]] * batch.num_rows, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=["row", "shares", "prediction", *(["leaves"] if leaves else [])])

        schema = StructType([rows.schema["row"], *fields, *([StructField("leaves", ArrayType(IntegerType()))] if leaves else [])])
        return rows.mapInArrow(run, schema).select("row.*", *added)

    def importance(self) -> dict[str, float]:
        """Shares of the features in the gains by weight, of each tree first and then of the mean of the trees."""
        total = np.zeros(len(self.features))
        for nodes in self.trees:
            own = np.zeros(len(self.features))
            for n in nodes:
                if "feature" in n:
                    own[n["feature"]] += n["gain"] * float(weight_of(np.array(n["sums"]), self.params.impurity))
            total += own / own.sum() if own.sum() else own
        return dict(zip(self.features, (total / total.sum() if total.sum() else total).tolist(), strict=True))

    def table(self, spark: SparkSession) -> DataFrame:
        """tree, node, depth, feature, threshold (numbers: left up to it), categories (those left; null: the missing), left, right, gain, weight, value."""
        out = []
        for t, nodes in enumerate(self.trees):
            for k, n in enumerate(nodes):
                threshold = kinds = None
                if "feature" in n:
                    kind, values = self.spec[n["feature"]]
                    if kind == "category":
                        kinds = [values[c - 1] if c else None for c in sorted(n["codes"])]
                    else:
                        threshold = float(values[max(n["codes"]) - 1]) if max(n["codes"]) else None
                some = "sums" in n
                out.append((t, k, n["depth"], self.features[n["feature"]] if "feature" in n else None, threshold, kinds, n.get("left"), n.get("right"), n.get("gain"), float(weight_of(np.array(n["sums"]), self.params.impurity)) if some else 0.0, self._value(n) if some else None))
        return spark.createDataFrame(out, "tree int, node int, depth int, feature string, threshold double, categories array<string>, left int, right int, gain double, weight double, value array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        held = json.loads(spark.read.parquet(path).first()["model"])
        held["params"], held["spec"] = Params(**held["params"]), [tuple(s) for s in held["spec"]]
        return Forest(**held)
