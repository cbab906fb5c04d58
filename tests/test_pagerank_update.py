"""Ranks after a change of edges against ranks from scratch."""

import random

import pytest

from tessera.operators import graph


def ranks_of(df):
    return {r["id"]: r["rank"] for r in df.collect()}


@pytest.fixture(scope="module")
def edges():
    """Fifty rings of eight vertices, chained from ring to ring one way."""
    made = [(8 * r + k, 8 * r + (k + 1) % 8) for r in range(50) for k in range(8)] + [(8 * r, 8 * r + 8) for r in range(49)]
    return made + [(8 * r + 2, 8 * r + 6) for r in range(50)]


def test_equal_to_ranks_from_scratch(spark, edges):
    rng = random.Random(1)
    table = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    gone = rng.sample(edges, 12)
    more = [(rng.randrange(400), rng.randrange(400)) for _ in range(10)] + [(500, 3), (17, 501)]
    more = [e for e in more if e not in edges]
    old = graph.pagerank(table(edges), reset=0.6, tolerance=1e-9)
    ranks, _ = graph.pagerank_update(table(edges), old, table(more), table(gone), reset=0.6, tolerance=1e-9)
    want = ranks_of(graph.pagerank(table([e for e in edges if e not in gone] + more), reset=0.6, tolerance=1e-9))
    got = ranks_of(ranks)
    assert set(got) >= set(want) and all(abs(got[v] - want[v]) < 1e-7 for v in want)
    assert all(abs(got[v] - 0.6) < 1e-7 for v in set(got) - set(want))


def test_only_what_follows_is_touched(spark, edges):
    table = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    old = graph.pagerank(table(edges), reset=0.6, tolerance=1e-9)
    ranks, touched = graph.pagerank_update(table(edges), old, table([(8 * 45 + 1, 8 * 45 + 5)]), reset=0.6, tolerance=1e-9)
    there = {r["id"] for r in touched.collect()}
    assert min(there) >= 8 * 45 and len(there) <= 40
    before, after = ranks_of(old), ranks_of(ranks)
    assert all(before[v] == after[v] for v in before if v not in there)
    same, none = graph.pagerank_update(table(edges), old, table([]), reset=0.6)
    assert ranks_of(same) == before and none.count() == 0


def test_purchases_are_worked_out_once_for_a_warm_start(spark, monkeypatch):
    from tessera.operators import graph
    from tessera.plans import more_queries

    read, real = [], graph.pagerank

    def watched(edges, *rest, **more):
        read.append(edges._jdf.queryExecution().optimizedPlan().toString())
        return real(edges, *rest, **more)

    monkeypatch.setattr(graph, "pagerank", watched)
    assert more_queries.warm_start(spark, "/root/testdata/sf0.001").count() > 0
    assert len(read) == 2 and not any("l_partkey" in p or "Join" in p for p in read)


def test_a_round_of_ranks_sorts_no_edges(spark, monkeypatch):
    from tessera.operators import graph

    plans = []

    def watched(df, cut=graph.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graph, "cut", watched)
    assert graph.pagerank(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long"), 2).count() == 4
    lines, above = plans[-1].split("\n"), []
    for k, line in enumerate(lines):
        if "InMemoryTableScan [src" in line:  # whether a sort or the join of the round is next above it
            above.append(next(x for x in lines[k - 1 :: -1] if "Sort [" in x or "SortMergeJoin" in x or "Aggregate" in x))
    assert any("SortMergeJoin" in x for x in above) and not any("Sort [" in x for x in above)
