"""Louvain and modularity with weights and direction against all partitions of small graphs."""

import random

import pytest

from tessera.operators import communities, graph

SCHEMA = "src long, dst long, w double"


def quality(edges, place, directed):
    """Modularity by its definition, over all ordered pairs of vertices."""
    a = {}
    for s, d, w in edges:
        if s != d:
            for x, y in ((s, d),) if directed else ((s, d), (d, s)):
                a[x, y] = a.get((x, y), 0) + w
    m = sum(a.values())
    out, into = {v: sum(w for (x, _), w in a.items() if x == v) for v in place}, {v: sum(w for (_, y), w in a.items() if y == v) for v in place}
    return sum(a.get((x, y), 0) / m - out[x] * into[y] / m**2 for x in place for y in place if place[x] == place[y])


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for k, block in enumerate(rest):
            yield [*rest[:k], [items[0], *block], *rest[k + 1 :]]


def drawn(seed):
    draw = random.Random(seed)
    edges = [(s, d, float(draw.randint(1, 4)) * (5 if s // 4 == d // 4 else 1)) for s in range(8) for d in range(8) if draw.random() < (0.7 if s // 4 == d // 4 else 0.25)]
    return [*edges, edges[0], (0, 1, 2.0), (0, 4, 1.0)]


@pytest.mark.parametrize("directed", [False, True])
def test_small_graphs_reach_nearly_the_best_partition(spark, directed):
    for seed in (1, 2):
        edges = drawn(seed)
        df = spark.createDataFrame(edges, SCHEMA)
        place = {r["id"]: r["community"] for r in communities.louvain(df, weight="w", directed=directed).collect()}
        assert set(place) == {v for s, d, _ in edges if s != d for v in (s, d)}
        best = max(quality(edges, {v: k for k, block in enumerate(p) for v in block}, directed) for p in partitions(sorted(place)))
        assert quality(edges, place, directed) > best - 0.03


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("weight", [None, "w"])
def test_modularity_by_definition(spark, directed, weight):
    edges = drawn(3)
    df = spark.createDataFrame([*edges, (2, 2, 50.0)], SCHEMA)
    place = {v: v % 3 for v in range(8)}
    c = spark.createDataFrame(sorted(place.items()), "id long, community long")
    if weight is None:
        edges = [(s, d, 1.0) for s, d in {(s, d) if directed else (min(s, d), max(s, d)) for s, d, _ in edges}]
    got = graph.modularity(df, c, weight, directed).first()["modularity"]
    assert got == pytest.approx(quality(edges, place, directed))


def test_no_edges_no_communities(spark):
    assert communities.louvain(spark.createDataFrame([(1, 1, 2.0)], SCHEMA), weight="w", directed=True).isEmpty()
