"""First centres and nearest centres against plain NumPy."""

import numpy as np
import pytest

from tessera.operators import centres

SCHEMA = "id long, vec array<double>"


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(10)
    middle = rng.normal(0, 20, (15, 5))
    return np.concatenate([c + rng.normal(0, 1, (80, 5)) for c in middle])


def cost_of(x, c):
    return ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()


def plus_plus(x, k, seed):
    rng = np.random.default_rng(seed)
    chosen = [x[rng.integers(len(x))]]
    while len(chosen) < k:
        d = ((x[:, None] - np.array(chosen)[None]) ** 2).sum(axis=2).min(axis=1)
        chosen.append(x[rng.choice(len(x), p=d / d.sum())])
    return np.array(chosen)


def test_parallel_centres_cost_no_more(spark, clusters):
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(clusters)], SCHEMA).repartition(4)
    made = np.array([r["vec"] for r in centres.parallel_centres(df, 15).orderBy("cluster").collect()])
    usual = np.median([cost_of(clusters, plus_plus(clusters, 15, s)) for s in range(9)])
    assert made.shape == (15, 5) and cost_of(clusters, made) <= usual
    assert np.isclose(centres.cost(df, dict(enumerate(made.tolist()))), cost_of(clusters, made))


def test_passes_do_not_depend_on_the_number(spark, clusters, monkeypatch):
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(clusters)], SCHEMA)
    passes = []
    monkeypatch.setattr(centres, "cut", lambda table, own=centres.cut: passes.append(1) or own(table))
    for k in (3, 40):
        passes.clear()
        centres.parallel_centres(df, k, rounds=3)
        assert len(passes) == 3


def test_nearest_centre_and_means(spark, clusters):
    rng = np.random.default_rng(1)
    c = np.concatenate([clusters[rng.choice(len(clusters), 20)], clusters[:1], clusters[:1]])
    x = np.concatenate([clusters, c])
    best, d = centres.nearest_centre(x, c)
    every = np.sqrt(((x[:, None] - c[None]) ** 2).sum(axis=2))
    assert (best == every.argmin(axis=1)).all() and np.allclose(d, every.min(axis=1))
    df = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)], SCHEMA + ", cluster string").repartition(3)
    numbered = {10 * k: v.tolist() for k, v in enumerate(c)}
    got = {r["id"]: r["cluster"] for r in centres.assign(df, numbered).collect()}
    assert [got[k] for k in range(len(x))] == (10 * every.argmin(axis=1)).tolist()
    means = centres.cluster_means(df, numbered)
    assert set(means) == set((10 * best).tolist()) and all(n == (best == c // 10).sum() and np.allclose(m, x[best == c // 10].mean(axis=0)) for c, (n, m) in means.items())


def test_weights_and_odd_tables(spark):
    x = np.array([[0.0], [1.0], [10.0]])
    assert np.allclose(np.sort(centres.weighted_centres(x, np.array([3.0, 1.0, 1.0]), 2), axis=0), [[0.25], [10.0]])
    assert len(centres.weighted_centres(x, np.array([1.0, 0.0, 0.0]), 2)) == 1
    alike = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(9)] + [(99, None)], SCHEMA)
    assert [r["vec"] for r in centres.parallel_centres(alike, 4).collect()] == [[1.0, 2.0]]
    assert centres.parallel_centres(alike.limit(0), 4).collect() == []
