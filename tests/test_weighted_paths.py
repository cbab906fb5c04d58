"""Weighted distances against a heap on one machine."""

import heapq
import random

import pytest

from tessera.operators import graph


def dijkstra(edges, source):
    out, heap = {}, [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in out:
            continue
        out[v] = d
        for a, b, w in edges:
            if a == v and w is not None and b not in out:
                heapq.heappush(heap, (d + w, b))
    return out


@pytest.mark.parametrize("width, directed", [(None, True), (0.5, False), (1000.0, True)])
def test_weighted_paths(spark, width, directed):
    rng = random.Random(3)
    edges = [(rng.randrange(25), rng.randrange(25), rng.choice([0.0, 1.0, 2.5, 7.0, 20.0])) for _ in range(60)] + [(k, k + 1, 1.0) for k in range(30, 36)] + [(1, 2, None), (3, 3, 1.0), (0, 1, 9.0), (0, 1, 3.0)]
    df = spark.createDataFrame(edges, "src long, dst long, amount double")
    plain = edges if directed else edges + [(b, a, w) for a, b, w in edges]
    sources = [0, 7, 30, 99]
    got = {(r["source"], r["id"]): r["distance"] for r in graph.weighted_paths(df, spark.createDataFrame([(s,) for s in sources], "id long"), "amount", width, directed).collect()}
    assert got == {(s, v): d for s in sources for v, d in dijkstra(plain, s).items()}
    near = {r["id"]: (r["reached"], r["closeness"]) for r in graph.weighted_closeness(df, spark.createDataFrame([(30,)], "id long"), "amount", width, directed).collect()}
    assert near == {30: (6, 6 / 21)}


def test_negative_weights_are_refused(spark):
    df = spark.createDataFrame([(1, 2, -1.0)], "src long, dst long, amount double")
    with pytest.raises(ValueError):
        graph.weighted_paths(df, spark.createDataFrame([(1,)], "id long"), "amount")
    empty = df.limit(0)
    assert [tuple(r) for r in graph.weighted_paths(empty, spark.createDataFrame([(1,)], "id long"), "amount").collect()] == [(1, 1, 0.0)]
