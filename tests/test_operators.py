"""Known answers on small hand-made inputs."""

import math

import pytest

from tessera.operators import boosting, graph, learning
from tessera.sources import edges as sources


def edge_table(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_core_numbers_and_triangles_of_a_clique_with_a_pendant(spark):
    e = edge_table(spark, [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (4, 5)])
    assert {r["id"]: r["core"] for r in graph.core_numbers(e).collect()} == {1: 3, 2: 3, 3: 3, 4: 3, 5: 1}
    assert sum(r["triangles"] for r in graph.triangles(e).collect()) == 12


def test_components_and_strong_components(spark):
    e = edge_table(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (7, 8)])
    assert {r["id"]: r["component"] for r in graph.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}
    assert {r["id"]: r["component"] for r in graph.strongly_connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 7: 7, 8: 8}


def test_betweenness_of_a_path(spark):
    e = edge_table(spark, [(1, 2), (2, 3)])
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(e, graph.vertices(e)).collect()}
    assert got[2] == 2.0 and got[1] == got[3] == 0.0


def test_betweenness_beyond_ten_hops(spark):
    e = edge_table(spark, [(k, k + 1) for k in range(13)])
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(e, graph.vertices(e), None).collect()}
    assert got == {k: 2.0 * k * (13 - k) for k in range(14)}


def test_queries_without_sql_take_the_whole_input(spark, monkeypatch):
    from pyspark.ml import clustering

    from tessera.plans import graph_queries, learning_queries, tables

    sf = "/root/testdata/sf0.001"
    taken, rates = {}, []
    for module, name in ((graph, "connected_components"), (graph, "strongly_connected_components"), (graph, "betweenness"), (learning, "simrank")):
        def keep(e, *rest, name=name):
            taken[name] = e.count()
            raise InterruptedError

        monkeypatch.setattr(module, name, keep)
    for query in (graph_queries.components, graph_queries.strong, graph_queries.betweenness, learning_queries.simrank):
        with pytest.raises(InterruptedError):
            query(spark, sf)
    supplies = tables.supply_graph(spark, sf).count()
    assert taken == {"connected_components": tables.together(spark, sf).count(), "strongly_connected_components": supplies, "betweenness": supplies, "simrank": tables.bought(spark, sf).count()}

    def fit(lda, rows, fitted=clustering.LDA.fit):
        rates.append(lda.getSubsamplingRate())
        return fitted(lda, rows)

    monkeypatch.setattr(clustering.LDA, "fit", fit)
    learning_queries.topics(spark, sf)
    assert rates == [1.0]


def test_dbscan_finds_two_clusters_and_noise(spark):
    pts = [(1, [0.0, 0.0]), (2, [0.1, 0.0]), (3, [0.0, 0.1]), (4, [5.0, 5.0]), (5, [5.1, 5.0]), (6, [5.0, 5.1]), (7, [9.0, 0.0])]
    got = {r["id"]: (r["label"], r["prediction"]) for r in learning.dbscan(spark.createDataFrame(pts, "id long, vec array<double>"), 0.3, 3).collect()}
    assert got[1][0] == got[2][0] == got[3][0] == 1 and got[4][0] == got[6][0] == 4 and got[7] == (None, -1)


def test_simrank_of_two_users_of_one_item(spark):
    rows = learning.simrank(spark.createDataFrame([(1, 1), (2, 1)], "user long, item long"), 0.6, 2).collect()
    assert [(r["side"], r["a"], r["b"], round(r["similarity"], 9)) for r in rows] == [("user", 1, 2, 0.6)]


def test_boosting_splits_at_the_step_and_handles_missing(spark):
    rows = spark.createDataFrame([(float(x) if x else None, float(x > 10)) for x in range(20)], "x double, y double")
    model = boosting.boost(rows, ["x"], "y", boosting.Params(rounds=20, depth=1))
    got = {r["x"]: r["margin"] for r in model.transform(rows).collect()}
    assert got[5.0] < 0.1 and got[15.0] > 0.9 and not math.isnan(got[None])
    assert set(model.importance()) == {"x"}


def test_objectives_on_arrays_are_those_on_columns(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tessera.functions import losses

    m, y = np.array([-2.0, -0.5, 0.3, 1.7, 0.9]), np.array([0.0, 1.0, 1.0, 0.0, 1.0])
    rows = spark.createDataFrame(list(zip(m.tolist(), y.tolist(), strict=True)), "m double, y double").coalesce(1)
    for name, on_columns in losses.OBJECTIVES.items():
        want = np.array([list(r) for r in rows.select(*(c.cast("double") for c in on_columns(F.col("m"), F.col("y")))).collect()])
        assert np.stack(boosting.OBJECTIVES[name](m, y), axis=1) == pytest.approx(want, rel=1e-9), name


def plain_boost(x, y, rounds, depth, lam=1.0, eta=0.3, step=0.0):
    """Squared error over all cuts of complete columns, one node at a time."""
    import numpy as np

    def weight(g, h):
        w = -g / (h + lam)
        return float(np.clip(w, -step, step)) if step else w

    def score(g, h):
        w = weight(g, h)
        return -(2 * g * w + (h + lam) * w * w)

    def grow(rows, left):
        g, h = (m - y)[rows].sum(), float(len(rows))
        best = (1e-9, None)
        for f in range(x.shape[1]) if left else ():
            for c in np.unique(x[rows, f])[:-1]:
                low = x[rows, f] <= c
                a, b = (m - y)[rows][low].sum(), low.sum()
                if (found := score(a, b) + score(g - a, h - b) - score(g, h)) > best[0] + 1e-9:
                    best = (found, rows[low], rows[~low])
        if best[1] is None:
            out[rows] += eta * weight(g, h)
        else:
            grow(best[1], left - 1)
            grow(best[2], left - 1)

    m = np.zeros(len(y))
    for _ in range(rounds):
        out = np.zeros(len(y))
        grow(np.arange(len(y)), depth)
        m = m + out
    return m


@pytest.mark.parametrize("step", [0.0, 0.2])
def test_boosting_is_that_of_single_rows(spark, monkeypatch, step):
    import numpy as np

    monkeypatch.setattr(boosting, "RENEW", 2)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (150, 3)).astype(float)
    y = x[:, 0] - 2 * (x[:, 1] > 5) * x[:, 2] + rng.normal(0, 0.5, 150)
    rows = spark.createDataFrame([(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double")
    model = boosting.boost(rows, ["a", "b", "c"], "y", boosting.Params(rounds=5, depth=3, max_delta_step=step))
    got = {r["id"]: r["margin"] for r in model.transform(rows).collect()}
    assert [got[k] for k in range(150)] == pytest.approx(plain_boost(x, y, 5, 3, step=step).tolist(), abs=1e-9)
    parts = {r["id"]: sum(r["contributions"]) for r in model.contributions(rows).collect()}
    assert parts == pytest.approx(got)


def test_boosting_options(spark):
    rows = spark.range(400).selectExpr("id", "id % 20 / 1.0d as a", "(id * 7) % 13 / 1.0d as b", "case when id % 20 > 9 then 1.0d else 0.0d end as y", "case when id % 2 = 0 then 1.0d else 0.0d end as w", "5.0d as m")
    P = boosting.Params
    heavy = boosting.boost(rows, ["a", "b"], "y", P(rounds=3, depth=2), weight="w")
    same = boosting.boost(rows.filter("w = 1"), ["a", "b"], "y", P(rounds=3, depth=2))
    assert [[(n.get("feature"), n["g"]) for n in t] for t in heavy.trees] == [[(n.get("feature"), n["g"]) for n in t] for t in same.trees]
    assert boosting.boost(rows, ["a"], "y", P(rounds=1, depth=1), margin="m").trees[0][0]["g"] == pytest.approx(400 * 5 - 200)
    half = boosting.boost(rows, ["a", "b"], "y", P(rounds=2, depth=1, subsample=0.5))
    assert all(140 < t[0]["h"] < 260 for t in half.trees) and half.trees[0][0]["h"] != half.trees[1][0]["h"]
    drawn = boosting.boost(rows, ["a", "b"], "y", P(rounds=6, depth=1, colsample_bytree=0.5)).trees
    assert 0 < sum(t[0].get("feature") == "a" for t in drawn) < 6
    apart = boosting.boost(rows.withColumn("y", rows["a"] * rows["b"]), ["a", "b"], "y", P(rounds=2, depth=3, interactions=[["a"], ["b"]]))
    assert all(len({n["feature"] for n in t if "feature" in n}) == 1 for t in apart.trees)
    stopped = boosting.boost(rows, ["a"], "y", P(rounds=40, depth=1, eta=1.0, reg_lambda=0.0), valid=rows.withColumn("y", 1 - rows["y"]), patience=3)
    assert len(stopped.history) == 4 and len(stopped.trees) == 1
    assert len(boosting.boost(rows, ["a"], "y", P(rounds=9, depth=1), callback=lambda turn, _: turn == 1).trees) == 2
    cv = boosting.cross_validate(rows, ["a"], "y", P(rounds=4, depth=1), folds=3)
    assert len(cv) == 4 and cv[-1][0] < cv[0][0]
    own = boosting.boost(rows, ["a"], "y", P(rounds=2, depth=1, objective=lambda m, y: (m - y, m * 0 + 1)))
    assert own.trees == boosting.boost(rows, ["a"], "y", P(rounds=2, depth=1)).trees


def test_pairwise_ranking_orders_within_groups(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(boosting, "RENEW", 3)
    rows = spark.range(600).selectExpr("id", "id % 30 as q", "(id * 7) % 11 / 1.0d as a", "100.0d * (id % 30) as b").selectExpr("*", "cast((a > 3) as int) + cast((a > 7) as int) as y")
    model = boosting.boost(rows, ["a", "b"], "y", boosting.Params(objective="rank_pairwise", rounds=8, depth=2), group="q")
    by = {}
    for r in model.transform(rows).collect():
        by.setdefault(r["y"], set()).add(round(r["margin"], 6))
    assert max(by[0]) < min(by[1]) and max(by[1]) < min(by[2]) and set(model.importance()) == {"a"}
    model.save(spark, str(tmp_path / "m"))
    again = boosting.Model.load(spark, str(tmp_path / "m"))
    assert again.trees == model.trees and again.cuts == model.cuts and again.params == model.params


def test_stored_tables_and_numbers_of_names(spark, tmp_path):
    from tessera.sources import stored

    df = spark.createDataFrame([("x", "y", 1.5), ("y", "z", 2.5), (None, "z", 0.5)], "a string, b string, w double")
    stored.write_columns(df, str(tmp_path / "o"))
    back = stored.read_columns(spark, str(tmp_path / "o"), ["b", "w"])
    assert sorted(map(tuple, back.collect())) == [("y", 1.5), ("z", 0.5), ("z", 2.5)]
    e, ids = stored.numbered(df, "a", "b")
    names = {r["id"]: r["name"] for r in ids.collect()}
    assert sorted((names[r["src"]], names[r["dst"]], r["w"]) for r in e.collect()) == [("x", "y", 1.5), ("y", "z", 2.5)] and len(names) == 3


def test_principal_components_are_those_of_the_covariance(spark):
    import numpy as np

    from tessera.operators import stats

    a = np.random.default_rng(4).normal(size=(80, 3)) @ np.array([[3.0, 1.0, 0.0], [0.0, 1.0, 0.5], [0.0, 0.0, 0.2]])
    share, loadings = stats.principal_components(spark.createDataFrame([tuple(map(float, r)) for r in a], "x double, y double, z double"), ["x", "y", "z"], 2)
    c = np.cov(a.T)
    values = np.sort(np.linalg.eigvalsh(c))[::-1]
    assert np.allclose(share, values[:2] / values.sum())
    for k in (0, 1):
        assert np.allclose(c @ np.array(loadings[k]), values[k] * np.array(loadings[k]))


def test_qr_and_singular_vectors(spark):
    import numpy as np

    from tessera.operators import matrices

    rng = np.random.default_rng(5)
    a = rng.normal(size=(60, 3)) @ np.diag([5.0, 1.0, 0.2])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(a)], "id long, x double, y double, z double")
    r, q = matrices.tall_qr(df, ["x", "y", "z"])
    rows = np.array([[t["q_x"], t["q_y"], t["q_z"]] for t in q.orderBy("id").collect()])
    assert np.allclose(rows @ r, a) and np.allclose(rows.T @ rows, np.eye(3)) and np.allclose(r, np.triu(r)) and (np.diag(r) > 0).all()
    s, v = matrices.singular_values(df, ["x", "y", "z"], 2)
    assert np.allclose(s, np.linalg.svd(a)[1][:2])
    u = np.array([[t["u0"], t["u1"]] for t in matrices.left_vectors(df, ["x", "y", "z"], s, v, ["u0", "u1"]).orderBy("id").collect()])
    assert np.allclose(a @ v, u * s) and np.allclose(u.T @ u, np.eye(2))


def test_buckets_without_pruning(spark):
    rows = spark.range(80).selectExpr("id", "id / 1.0d as x", "case when id < 40 then 0 else if(id % 3 = 0, 1, 0) end as y", "cast(null as double) as z")
    got, cuts = learning.bucketize(rows, ["x", "z"], "y", depth=1, bins=200)
    assert {r["id"]: (r["buckets"][0], r["buckets"][1]) for r in got.collect()} == {k: (int(k > 39) if cuts[0] == [39.0] else int(k > cuts[0][0]), None) for k in range(80)} and cuts[0] in ([39.0], [40.0], [41.0])


def test_kmeans_from_spread_centres(spark):
    import random

    rng = random.Random(2)
    points = spark.createDataFrame([(k, [10.0 * (k % 3) + rng.gauss(0, 0.3), 5.0 * (k % 3 == 1) + rng.gauss(0, 0.3)]) for k in range(150)], "id long, vec array<double>")
    start = learning.spread_centres(points, 3)
    assert sorted(round(r["vec"][0] / 10) for r in start.collect()) == [0, 1, 2]
    for share in (1.0, 0.5):
        found = sorted(r["vec"] for r in learning.kmeans(points, start, 20, tolerance=1e-3, share=share).collect())
        assert all(math.dist(a, b) < 0.5 for a, b in zip(found, [[0.0, 0.0], [10.0, 5.0], [20.0, 0.0]], strict=True))
    assert learning.spread_centres(points.filter("id < 2"), 5).count() == 2


def test_spearman_leaves_a_null_out_of_its_own_pairs_only(spark):
    from tessera.operators import stats

    rows = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 1.0, 2.0), (3.0, 5.0, None), (4.0, 7.0, 9.0)], "a double, b double, c double")
    got = {(r["a"], r["b"]): r["value"] for r in stats.spearman(rows, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(0.8) and got["a", "a"] == 1.0


def test_readers(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n%m\n1 2 0.5\n2\t3\n4,4\nx\n")
    assert sorted(map(tuple, sources.read_edges(spark, str(tmp_path / "e.txt"), weighted=True, loops=False).collect())) == [(1, 2, 0.5), (2, 3, 1.0)]
    (tmp_path / "v.txt").write_text("# ranks\n1 0.5\n2,1.5\n3\n")
    assert sorted(map(tuple, sources.read_values(spark, str(tmp_path / "v.txt")).collect())) == [(1, 0.5), (2, 1.5)]
    assert sorted(r["id"] for r in sources.read_ids(spark, str(tmp_path / "v.txt")).collect()) == [1, 2, 3]
    (tmp_path / "l.txt").write_text("1 1:0.5 3:2\n0 2:1\n")
    assert [(r["label"], r["features"].toArray().tolist()) for r in sources.read_labelled(spark, str(tmp_path / "l.txt")).orderBy("label").collect()] == [(0.0, [0.0, 1.0, 0.0]), (1.0, [0.5, 0.0, 2.0])]
    (tmp_path / "c.txt").write_text("(1,7)\n(2,7)\n")
    assert sorted(map(tuple, sources.read_communities(spark, str(tmp_path / "c.txt")).collect())) == [(1, 7), (2, 7)]
    (tmp_path / "p.txt").write_text("1\t0.5,2\n2 (1.5,3)\n")
    assert sorted((r["id"], r["vec"]) for r in sources.read_points(spark, str(tmp_path / "p.txt")).collect()) == [(1, [0.5, 2.0]), (2, [1.5, 3.0])]
    (tmp_path / "s.txt").write_text("1 2 -1 3 -1 -2\n")
    assert sources.read_sequences(spark, str(tmp_path / "s.txt")).collect()[0]["sequence"] == [[1, 2], [3]]
