"""Nearest neighbours by trees against all distances."""

import numpy as np
import pytest

from tessera.operators import neighbours as N

SCHEMA = "id long, vec array<double>"


def brute(points, queries, k, most=np.inf):
    out = []
    for q, v in queries:
        d = sorted((float(np.sqrt(((np.array(p) - v) ** 2).sum())), i) for i, p in points if i != q)
        out += [(q, i, round(x, 9), place + 1) for place, (x, i) in enumerate(d[:k]) if x <= most]
    return sorted(out)


def rows(df):
    return sorted((r["query"], r["neighbour"], round(r["distance"], 9), r["place"]) for r in df.collect())


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 30, (40, 6))
    x = np.concatenate([c + rng.normal(0, 1, (60, 6)) for c in centres] + [np.repeat(centres[:1], 300, axis=0)])
    return [(k, v.tolist()) for k, v in enumerate(x)]


def test_against_all_distances(spark, clusters, monkeypatch):
    """Clusters, three hundred copies of one point, ties, a bound, and blocks of a few points and queries."""
    monkeypatch.setattr(N, "MOST_POINTS", 90)
    monkeypatch.setattr(N, "MOST_QUERIES", 25)
    df = spark.createDataFrame(clusters, SCHEMA)
    asked = [p for p in clusters if p[0] % 20 == 0] + [(10_000, [0.0] * 6), (10_001, [500.0] * 6)]
    index = N.Index(df, parts=30)
    queries = spark.createDataFrame(asked, SCHEMA)
    assert rows(index.nearest(queries, 5)) == brute(clusters, asked, 5)
    assert rows(index.nearest(queries, 8, 1.9)) == brute(clusters, asked, 8, 1.9)
    assert rows(N.Index(df, parts=1).nearest(queries, 3)) == brute(clusters, asked, 3)


def test_queries_meet_few_parts(spark, clusters):
    index = N.Index(spark.createDataFrame(clusters[:2400], SCHEMA), parts=40)
    asked = spark.createDataFrame([p for p in clusters[:2400] if p[0] % 20 == 0], SCHEMA)
    met = index.routed(asked, 5).groupBy("id").count().toPandas()["count"]
    assert len(met) == 120 and met.mean() < 3 and met.max() <= 8 and index.tree.leaves.count(-1) >= 30


def test_uniform_points_and_a_tree_s_spill():
    rng = np.random.default_rng(1)
    x, q = rng.random((1500, 3)), rng.random((50, 3))
    tree = N.Tree.grow(x, 64, 0.1)
    assert sorted(np.concatenate(tree.members)) == list(range(1500)) and sum(map(len, tree.spilled)) > 1500
    assert all((tree.route(x[m]) == k).all() for k, m in enumerate(tree.members))
    searched = N.Searched(np.arange(1500), x)
    row, who, d = searched.search(np.full(50, -1), q, np.full(50, np.inf), 4)
    want = np.argsort(((q[:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, :4]
    assert (who.reshape(50, 4) == want).all()
    assert (searched.bounds(np.full(50, -1), q, 4) >= d.reshape(50, 4)[:, -1] - 1e-12).all()


def test_odd_rows(spark):
    points = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, None), (None, [0.0, 0.5]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [0.0, 1.0])]
    df = spark.createDataFrame(points, SCHEMA)
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (9, None), (None, [1.0, 1.0]), (8, [0.0, 1.0])], SCHEMA)
    near = N.nearest(df, queries, 2)
    assert rows(near) == [(1, 2, 1.0, 1), (1, 6, 1.0, 2), (8, 2, 0.0, 1), (8, 6, 0.0, 2)]
    wide = {r["id"]: (list(r["neighbours"]), list(r["distances"])) for r in N.with_neighbours(queries, near).collect()}
    assert wide == {1: ([2, 6], [1.0, 1.0]), 9: ([], []), None: ([], []), 8: ([2, 6], [0.0, 0.0])}
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(N.nearest(empty, queries, 2)) == [] and rows(N.nearest(df, empty, 2)) == []
    known = spark.createDataFrame([(2, 7, 1.0), (6, 8, 3.0)], "id long, y int, w double")
    assert {(r["query"], r["label"], r["share"]) for r in N.vote(near, known, "y", "w").collect()} == {(1, 8, 0.75), (8, 8, 0.75)}
    assert {(r["query"], r["label"]) for r in N.vote(near, known, "y").collect()} == {(1, 7), (8, 7)}
    assert {(r["query"], r["value"]) for r in N.weighted_mean(near, known, "y", "w").collect()} == {(1, 7.75), (8, 7.75)}


def test_moments_leave_out_rows_with_a_null(spark):
    from tessera.operators import stats as S

    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (None, 9.0)], "a double, b double")
    for f in (S.pearson, S.spearman):
        assert {(r["a"], r["b"]): round(r["value"], 12) for r in f(df, ["a", "b"]).collect()} == {("a", "a"): 1.0, ("a", "b"): 1.0, ("b", "b"): 1.0}
    assert S.regression(df, "b", "a").first().asDict() == {"slope": 1.5, "intercept": 0.5}
