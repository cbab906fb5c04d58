"""Queries of fitted models, which have no SQL, by what their results must satisfy."""

import collections
import math

import pytest

from tessera.plans import registry, tables

SF = "/root/testdata/sf0.001"
KEY = ("l_orderkey", "l_linenumber")


def result(spark, name):
    return registry.queries()[name](spark, SF)


@pytest.fixture(scope="module")
def lines(spark):
    return tables.flagged(spark, SF).collect()


def test_logistic_regression_has_no_gradient_left(spark, lines):
    """Lines may share a key: sums over all of them are compared."""
    p = [r["p"] for r in result(spark, "learn_logistic").collect()]
    assert abs(sum(p) - sum(r["y"] for r in lines)) < 1e-3 * len(lines) and all(0 < x < 1 for x in p)
    by = collections.Counter(tuple(r[k] for k in KEY) for r in lines)
    alone = {tuple(r[k] for k in KEY): r["p"] for r in result(spark, "learn_logistic").collect()}
    kept = [r for r in lines if by[tuple(r[k] for k in KEY)] == 1]
    for column, scale in (("l_quantity", 50), ("l_discount", 0.1), ("l_tax", 0.08)):
        assert abs(sum((alone[tuple(r[k] for k in KEY)] - r["y"]) * r[column] / scale for r in kept)) < 0.02 * len(kept)


@pytest.mark.parametrize("name", ["learn_linear_svc", "learn_forest"])
def test_classifiers_are_no_worse_than_the_commonest_class(spark, lines, name):
    predicted = result(spark, name).collect()
    most = max(collections.Counter(r["y"] for r in lines).values()) / len(lines)
    truth = collections.defaultdict(list)
    for r in lines:
        truth[tuple(r[k] for k in KEY)].append(r["y"])
    right = sum(r["prediction"] in truth[tuple(r[k] for k in KEY)] for r in predicted)
    assert len(predicted) == len(lines) and right >= (most - 0.01) * len(lines)


def test_tree_leaves_follow_the_feature(spark, lines):
    """One feature: leaves are ranges of it, and they explain most of the price."""
    leaf = {tuple(r[k] for k in KEY): r["leaf"] for r in result(spark, "learn_tree_leaves").collect()}
    by = collections.defaultdict(list)
    for r in lines:
        by[leaf[tuple(r[k] for k in KEY)]].append(r)
    assert 4 < len(by) <= 16
    mean = lambda x: sum(x) / len(x)
    prices = [r["l_extendedprice"] for r in lines]
    whole = sum((p - mean(prices)) ** 2 for p in prices)
    within = sum((r["l_extendedprice"] - mean([x["l_extendedprice"] for x in g])) ** 2 for g in by.values() for r in g)
    assert within < whole


def test_recommendations_are_ranked_and_fit_what_was_bought(spark):
    got = collections.defaultdict(list)
    for r in result(spark, "recommend_als").orderBy("user", "place").collect():
        got[r["user"]].append((r["item"], r["rating"]))
    users = {r["user"] for r in tables.bought(spark, SF).select("user").distinct().collect()}
    assert set(got) == users and all(len({i for i, _ in x}) == 3 and [s for _, s in x] == sorted((s for _, s in x), reverse=True) for x in got.values())


def test_topics_have_terms_of_their_own(spark):
    topics = collections.defaultdict(list)
    for r in result(spark, "text_topics").collect():
        topics[r["topic"]].append(r["term"])
    assert len(topics) == 4 and all(len(set(t)) == 8 for t in topics.values()) and len({frozenset(t) for t in topics.values()}) > 1


def test_boosted_queries_agree_with_themselves(spark, lines):
    classes = result(spark, "boost_classes").collect()
    assert len(classes) == len(lines) and all(abs(r["p0"] + r["p1"] + r["p2"] - 1) < 1e-5 for r in classes)
    p = result(spark, "boost_classify").collect()
    loss = lambda q: -sum(math.log(q[k] if r["y"] else 1 - q[k]) for k, r in enumerate(lines)) / len(lines)
    share = sum(r["y"] for r in lines) / len(lines)
    by = collections.defaultdict(list)
    for r in p:
        by[tuple(r[k] for k in KEY)].append(r["p"])
    assert loss([sum(x) / len(x) for x in (by[tuple(r[k] for k in KEY)] for r in lines)]) < loss([share] * len(lines)) and all(len(r["leaves"].split(",")) == 10 for r in p)
    assert len(result(spark, "boost_dropping").collect()) == len(lines)
    table = result(spark, "boost_model_table").collect()
    assert {r["tree"] for r in table} == {0, 1} and all((r["feature"] is None) == (r["weight"] is not None) for r in table)
    vectors = result(spark, "graph_node_vectors").collect()
    assert vectors and all(len(r["vector"]) == 16 for r in vectors)
