"""Quantile summaries and Shapley values against exact ones."""

import itertools
import math

import numpy as np
import pytest

from tessera.functions import sketch
from tessera.operators import attributions, boosting


def ranks(value, weight, x):
    return weight[value < x].sum(), weight[value <= x].sum()


@pytest.mark.parametrize("size", [20, 60])
def test_summaries_merge_and_prune_within_bounds(size):
    rng = np.random.default_rng(4)
    value, weight = np.round(rng.gamma(1.0, 20, 4000), 1), rng.integers(0, 5, 4000).astype(float)
    parts = [sketch.Summary.of(v, w).pruned(size) for v, w in zip(np.array_split(value, 8), np.array_split(weight, 8))]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merged(p)
    again = sketch.Summary.unpacked(whole.pruned(size).packed())
    assert len(again.value) <= size and again.total == weight.sum()
    for s, room in ((whole, 1.0), (again, 1.0)):
        for x, low, high, own in zip(s.value, s.low, s.high, s.weight):
            below, upto = ranks(value, weight, x)
            assert low <= below + 1e-9 and upto <= high + 1e-9 and own <= upto - below + 1e-9
    targets = np.linspace(0, 1, 21) * weight.sum()
    for r, k in zip(targets, again.nearest(targets)):
        below, upto = ranks(value, weight, again.value[k])
        assert below - 2.5 * weight.sum() / size <= r <= upto + 2.5 * weight.sum() / size


def test_weighted_quantiles_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(sketch, "HELD", 300)
    rng = np.random.default_rng(6)
    x, w = rng.lognormal(0, 2, 6000), rng.random(6000) * 3
    rows = [(float(a), float(b), float(k % 7)) for k, (a, b) in enumerate(zip(x, w))] + [(None, 1.0, 3.0), (float("nan"), 1.0, None), (1.0, 0.0, None)]
    df = spark.createDataFrame(rows, "x double, w double, y double").repartition(7)
    got, few = sketch.summaries(df, ["x", "y"], lambda b: b.column("w").to_numpy(), 0.01)
    assert math.isclose(got.total, w.sum(), rel_tol=1e-9) and len(got.value) <= 600 and few.value.tolist() == [float(k) for k in range(7)]
    for k in range(1, 50):
        below, upto = ranks(x, w, got.value[got.nearest(np.array([k / 50 * w.sum()]))[0]])
        assert below - 0.01 * w.sum() <= k / 50 * w.sum() <= upto + 0.01 * w.sum()
    assert sketch.cuts(few, 10) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and len(sketch.cuts(got, 32)) == 31
    (none,) = sketch.summaries(df.limit(0), ["x"], lambda b: b.column("w").to_numpy(), 0.1)
    assert sketch.cuts(none, 8) == [] and none.total == 0


def test_cuts_follow_the_hessians(spark):
    """Rows of certain margins hardly count: nearly all cuts lie among the others."""
    rows = [(float(k), k % 2, 30.0 if k < 900 else 0.0) for k in range(1000)]
    df = spark.createDataFrame(rows, "x double, y int, m double")
    p = boosting.Params(objective="logistic", bins=10)
    made = boosting._cuts(df, ["x"], 10, p, "y", None, "m")["x"]
    assert sum(c >= 900 for c in made) >= 8
    even = boosting._cuts(df, ["x"], 10, boosting.Params(objective="squared_error"), "y")["x"]
    assert np.allclose(even, np.arange(1, 10) * 100, atol=12)


def value_of(tree, features, row, known, k=0):
    """A tree's value with the features of ``known`` given, by its definition."""
    node = tree[k]
    if "feature" not in node:
        return node["weight"]
    f = features.index(node["feature"])
    if f in known:
        left = node["missing_left"] if row[f] < 0 else row[f] <= node["bin"]
        return value_of(tree, features, row, known, node["left"] if left else node["right"])
    a, b = tree[node["left"]]["h"], tree[node["right"]]["h"]
    return (a * value_of(tree, features, row, known, node["left"]) + b * value_of(tree, features, row, known, node["right"])) / (a + b)


def enumerated(tree, features, row):
    n = len(features)
    v = {s: value_of(tree, features, row, set(s)) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
    single, pair = np.zeros(n), np.zeros((n, n))
    for s in v:
        for i in set(range(n)) - set(s):
            with_i = tuple(sorted((*s, i)))
            single[i] += math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (v[with_i] - v[s])
            for j in set(range(n)) - set(with_i):
                delta = v[tuple(sorted((*with_i, j)))] - v[with_i] - v[tuple(sorted((*s, j)))] + v[s]
                pair[i, j] += math.factorial(len(s)) * math.factorial(n - len(s) - 2) / (2 * math.factorial(n - 1)) * delta
    pair[np.arange(n), np.arange(n)] = single - pair.sum(axis=1)
    return single, pair, v[()]


@pytest.mark.parametrize("table", [8, 1])
def test_shapley_values_by_all_subsets(spark, monkeypatch, table):
    monkeypatch.setattr(attributions, "TABLE", table)
    rng = np.random.default_rng(12)
    features = ["a", "b", "c", "d"]
    x = np.round(rng.normal(size=(400, 4)), 1)
    y = x[:, 0] * x[:, 1] + np.where(x[:, 2] > 0, 2 * x[:, 0], 1.0)
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in r) + (float(t),) for r, t in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double")
    model = boosting.boost(df, features, "y", boosting.Params(rounds=2, depth=5, bins=16, base_margin=0.5))
    some = df.limit(25)
    got = model.interactions(model.shapley(model.transform(some))).collect()
    for r in got:
        bins = [-1 if r[f] is None else int(np.searchsorted(model.cuts[f], r[f], "left")) for f in features]
        parts = [enumerated(t, features, bins) for t in model.trees]
        single, pair, mean = (sum(p[k] for p in parts) for k in range(3))
        assert np.allclose(r["contributions"], [*single, mean + 0.5])
        assert np.allclose(np.array(r["interactions"])[:4, :4], pair) and abs(sum(r["contributions"]) - r["margin"]) < 1e-9
        assert np.allclose(np.array(r["interactions"])[:4].sum(axis=1), single)
