"""Areas by group and weight, significance and metrics with a parameter against plain loops."""

import math

import numpy as np
import pytest

from tessera.functions import curves, losses

SCHEMA = "g string, p double, y double, w double"


def rows(n=300):
    draw = np.random.default_rng(9)
    out = [("ab"[int(draw.integers(0, 2))] if draw.random() < 0.9 else None, float(draw.integers(0, 20)), float(draw.random() < 0.4), float(draw.integers(1, 5))) for _ in range(n)]
    return [*out, ("one", 1.0, 1.0, 1.0), ("none", 1.0, 0.0, 1.0), ("a", None, 1.0, 1.0), ("a", 3.0, None, 1.0), ("a", 3.0, 1.0, None)]


def test_areas(spark):
    data = rows()
    got = {r["group"]: r for r in curves.areas(spark.createDataFrame(data, SCHEMA), "p", "y", "w", "g").collect()}
    assert set(got) == {"a", "b", None, "one", "none"}
    for g, found in got.items():
        own = [r[1:] for r in data if r[0] == g and None not in r[1:]]
        pos, neg = [[(p, w) for p, y, w in own if y == k] for k in (1.0, 0.0)]
        if not pos or not neg:
            assert found["auc"] is None
            continue
        won = sum(w * v * ((p > q) + (p == q) / 2) for p, w in pos for q, v in neg)
        assert found["auc"] == pytest.approx(won / (sum(w for _, w in pos) * sum(w for _, w in neg)))
        above = [(sum(v for q, v in pos if q >= p), sum(v for q, _, v in own if q >= p)) for p, _ in pos]
        assert found["aucpr"] == pytest.approx(sum(w * a / b for (_, w), (a, b) in zip(pos, above, strict=True)) / sum(w for _, w in pos))
    assert got["one"]["aucpr"] == 1
    assert got["none"]["aucpr"] is None
    whole = curves.areas(spark.createDataFrame(data, SCHEMA), "p", "y").collect()
    assert len(whole) == 1 and 0 < whole[0]["auc"] < 1
    assert curves.areas(spark.createDataFrame([], SCHEMA), "p", "y", "w", "g").isEmpty()


def value(s, b):
    return math.sqrt(2 * ((s + b + 10) * math.log(1 + s / (b + 10)) - s))


def test_significance(spark):
    distinct = [(None, float(i), float(i % 3 == 0), float(1 + i % 4)) for i in range(100)]
    df = spark.createDataFrame(distinct, SCHEMA)
    for share in (0.05, 0.3, 0.77):
        top = sorted(distinct, key=lambda r: -r[1])[: int(share * 100)]
        want = value(sum(w for *_, y, w in top if y), sum(w for *_, y, w in top if not y))
        assert curves.ams(df, "p", "y", share, "w").first()["ams"] == pytest.approx(want)
    order = sorted(distinct, key=lambda r: -r[1])
    best = max(value(sum(w for *_, y, w in order[:k] if y), sum(w for *_, y, w in order[:k] if not y)) for k in range(1, 100))
    assert curves.ams(df, "p", "y", 1.0, "w").first()["ams"] == pytest.approx(best)
    tied = spark.createDataFrame([(None, 1.0, 1.0, 4.0), (None, 1.0, 0.0, 2.0)], SCHEMA)
    assert curves.ams(tied, "p", "y", 0.5, "w").first()["ams"] == pytest.approx(value(2, 1))
    assert curves.ams(tied, "p", "y").first()["ams"] == 0


def test_metrics_with_a_parameter(spark):
    df = spark.createDataFrame([(None, 0.2, 1.0, 1.0), (None, 0.6, 0.0, 3.0)], SCHEMA)
    got = losses.evaluate(df, "p", "y", ["error", "error@0.1", "tweedie_nloglik", "tweedie_nloglik@1.5"], "w").first()
    assert (got["error"], got["error@0.1"]) == (1.0, 0.75)
    assert got["tweedie_nloglik@1.5"] == pytest.approx(got["tweedie_nloglik"])
    with pytest.raises(ValueError, match="no metric"):
        losses.metric("tweedie_nloglik@2.5")
    with pytest.raises(ValueError, match="no metric"):
        losses.metric("rmse@1")
