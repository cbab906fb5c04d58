"""Trees and forests against one machine that tries every cut and every set of categories."""

import itertools
import math

import numpy as np
import pytest

from tessera.operators import forest as R

SCHEMA = "id long, x double, c string, y string, z double"


def rows(n=400, seed=3):
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x, c = float(draw.integers(0, 12)), "pqrst"[draw.integers(0, 5)]
        y = "abc"[int((x > 5) + (c in "pt") * (draw.random() < 0.8)) % 3] if draw.random() < 0.9 else "c"
        out.append((i, None if i % 29 == 0 else x, None if i % 31 == 0 else c, y, float(3 * (x > 7) + 5 * (c in "qs") + draw.normal())))
    return out


def impurity(part, kind):
    """Impurity times weight of (weight, label) pairs."""
    n = sum(w for w, _ in part)
    if not n:
        return 0.0
    if kind == "variance":
        mean = sum(w * y for w, y in part) / n
        return sum(w * (y - mean) ** 2 for w, y in part)
    found = {}
    for w, y in part:
        found[y] = found.get(y, 0) + w
    return n - sum(v * v for v in found.values()) / n if kind == "gini" else -sum(v * math.log2(v / n) for v in found.values() if v)


def best_gain(part, kind, features):
    """The largest gain over the features, from (weight, x, c, label) rows, over every cut and every set of categories."""
    n, whole, best = sum(r[0] for r in part), impurity([(r[0], r[3]) for r in part], kind), 0.0
    tests = []
    if 0 in features:
        tests += [lambda r, v=v: (-1 if r[1] is None else r[1]) <= v for v in {-1 if r[1] is None else r[1] for r in part}]
    if 1 in features:
        kinds = sorted({r[2] or "" for r in part})
        tests += [lambda r, s=s: (r[2] or "") in s for k in range(1, len(kinds)) for s in itertools.combinations(kinds, k)]
    for test in tests:
        sides = [[(r[0], r[3]) for r in part if test(r) == side] for side in (True, False)]
        if all(sides):
            best = max(best, (whole - sum(impurity(s, kind) for s in sides)) / n)
    return best


@pytest.mark.parametrize(("kind", "label"), [("gini", "y"), ("entropy", "y"), ("variance", "z")])
@pytest.mark.parametrize("bags", [False, True])
def test_every_split_gains_as_much_as_the_best_of_all(spark, kind, label, bags):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    p = R.Params(trees=3, depth=3, impurity=kind, subset=0.5, seed=11) if bags else R.Params(depth=3, impurity=kind, **R.SINGLE)
    model = R.grow(df, ["x", "c"], label, "id", p, ("c",))
    held = {r["id"]: r["bag"] for r in R.bagged(df, "id", p).collect()}
    assert len({tuple(r["leaves"]) for r in model.predict(df, leaves=True).collect()}) > 2
    for t, nodes in enumerate(model.trees):
        parts = {0: [(held[i][t], x, c, y if label == "y" else z) for i, x, c, y, z in data if held[i][t]]}
        for k, node in enumerate(nodes):
            part = parts[k]
            assert R.weight_of(np.array(node["sums"]), kind) == sum(r[0] for r in part)
            best = best_gain(part, kind, set(R.node_features(2, t, k, p)))
            if "feature" not in node:
                assert node["depth"] == 3 or best < 1e-9
                continue
            assert node["gain"] == pytest.approx(best, abs=1e-9)
            kinds, cuts = model.spec[1][1], model.spec[0][1]
            left = (lambda r, n=node: (kinds.index(r[2]) + 1 if r[2] is not None else 0) in n["codes"]) if node["feature"] else (lambda r, n=node: (sum(v < r[1] for v in cuts) + 1 if r[1] is not None else 0) in n["codes"])
            parts[node["left"]], parts[node["right"]] = ([r for r in part if left(r) == side] for side in (True, False))


def test_two_classes_and_many_categories_need_their_order_only():
    draw = np.random.default_rng(5)
    for kind in ("gini", "entropy"):
        for _ in range(30):
            sums = draw.integers(1, 30, (8, 2)).astype(float)
            gain, codes, _ = R.best_split(np.arange(8), sums, True, R.Params(impurity=kind))
            every = []
            for mask in range(1, 255):
                left = sums[[bool(mask >> k & 1) for k in range(8)]].sum(0)
                every.append(float(R.spread(sums.sum(0), kind) - R.spread(left, kind) - R.spread(sums.sum(0) - left, kind)) / sums.sum())
            assert gain == pytest.approx(max(every), abs=1e-9)
            assert 0 < len(codes) < 8


def test_predictions_are_means_of_the_leaves(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    model = R.grow(df, ["x", "c"], "y", "id", R.Params(trees=4, depth=3), ("c",))
    table = {(r["tree"], r["node"]): r["value"] for r in model.table(spark).collect()}
    for r in model.predict(df, leaves=True).collect():
        shares = np.mean([table[t, k] for t, k in enumerate(r["leaves"])], axis=0)
        assert np.allclose(shares, r["shares"])
        assert r["prediction"] == model.classes[int(np.argmax(r["shares"]))]
    right = model.predict(df).filter("prediction = y").count()
    assert right > 0.7 * df.count()
    assert sum(model.importance().values()) == pytest.approx(1.0)


def test_a_forest_repeats_under_a_seed_only_and_is_saved(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    grown = [R.grow(d, ["x", "c"], "z", "id", R.Params(trees=3, depth=3, impurity="variance", seed=s), ("c",)) for d, s in ((df, 1), (df.repartition(5), 1), (df, 2))]
    first, again, other = ([sorted(map(repr, ((r["id"], round(r["prediction"], 6)) for r in m.predict(df).collect())))] for m in grown)
    assert first == again != other
    grown[0].save(spark, str(tmp_path / "forest"))
    back = R.Forest.load(spark, str(tmp_path / "forest"))
    assert back.predict(df).exceptAll(grown[0].predict(df)).isEmpty()


def test_bags(spark):
    ids = spark.range(20000)
    drawn = np.array([r["bag"] for r in R.bagged(ids, "id", R.Params(trees=2, subsample=0.7)).collect()])
    assert np.allclose(drawn.mean(0), 0.7, atol=0.03)
    assert np.allclose(drawn.var(0), 0.7, atol=0.05)
    assert abs(np.corrcoef(drawn.T)[0, 1]) < 0.03
    once = np.array([r["bag"] for r in R.bagged(ids, "id", R.Params(trees=1, subsample=0.3, replacement=False)).collect()])
    assert set(once.ravel()) == {0.0, 1.0}
    assert abs(once.mean() - 0.3) < 0.02


def test_few_cells_a_pass_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    p = R.Params(trees=3, depth=3)
    whole = R.grow(df, ["x", "c"], "y", "id", p, ("c",)).trees
    monkeypatch.setattr(R, "CELLS", 100)
    assert R.grow(df, ["x", "c"], "y", "id", p, ("c",)).trees == whole


def test_odd_rows(spark):
    odd = [(1, float("nan"), "new", None, 1.0), (2, None, None, "a", None), (3, 1.0, "", "b", float("nan")), (3, 1.0, "", "b", 2.0), (None, 2.0, "p", "a", 3.0)]
    df = spark.createDataFrame(odd, SCHEMA).withColumn("row", R.F.lit(1)).withColumn("f0", R.F.lit("x"))
    for label, kind in (("y", "gini"), ("z", "variance")):
        model = R.grow(df, ["x", "c"], label, "id", R.Params(depth=2, impurity=kind, **R.SINGLE), ("c",))
        got = model.predict(df)
        assert got.count() == 5
        assert got.columns == [*df.columns, "prediction", "shares"]
        assert got.filter("prediction is null").isEmpty()
        empty = R.grow(df.filter("id = 1 and id = 2"), ["x", "c"], label, "id", R.Params(depth=2, impurity=kind), ("c",))
        assert empty.predict(df).filter("prediction is not null").isEmpty()
        assert model.predict(df.limit(0)).isEmpty()
    with pytest.raises(ValueError, match="more categories"):
        R.grow(df, ["c"], "y", "id", R.Params(bins=1), ("c",))
    with pytest.raises(ValueError, match="added here"):
        model.predict(df.withColumn("shares", R.F.lit(1)))
