"""Operators whose rows must not grow with all pairs or all paths, against plain counts."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators import graph as G


def edge_table(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def test_squares_count_every_closed_walk_without_listing_them(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(14), rng.randrange(14)) for _ in range(45)] + [(20, 21), (21, 22)]
    near = {}
    for a, b in rows:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for a, b, c, d in permutations(near, 4):
        if b in near[a] and c in near[b] and d in near[c] and a in near[d]:
            want[a] = want.get(a, 0) + 1
    assert {r["id"]: r["squares"] for r in graph.squares(edge_table(spark, rows)).collect()} == want

    from tessera.plans import graph_queries

    monkeypatch.setattr(graph, "match_subgraph", None)
    assert graph_queries.squares(spark, "/root/testdata/sf0.001").count() > 0


def test_distances_from_all_vertices_move_a_row_for_64_sources(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(a, rng.randrange(150)) for a in range(150) for _ in range(4)] + [(k, k + 1) for k in range(200, 253)]
    e = edge_table(spark, rows)
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
    want = {}
    for s in {v for row in rows for v in row}:
        front, hop = {s}, 0
        seen = {s}
        while front:
            want |= {(s, v): hop for v in front}
            front = {w for v in front for w in near.get(v, ())} - seen
            seen |= front
            hop += 1
    sizes, real = [], graph.cut

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    got = [((r["source"], r["id"]), r["distance"]) for r in graph.shortest_paths(e, graph.vertices(e)).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert max(sizes) < len(want) / 4
    few = graph.shortest_paths(e, graph.vertices(e).filter("id in (3, 200)"), 2).collect()
    assert {(r["source"], r["id"]): r["distance"] for r in few} == {k: d for k, d in want.items() if k[0] in (3, 200) and d <= 2}


def test_closeness_moves_a_row_for_1024_sources_and_none_for_a_pair(spark, monkeypatch):
    n = 1500
    e = edge_table(spark, [(k, (k + by) % n) for k in range(n) for by in (1, 5, 25, 125, 600)])
    hops, front = {0: 0}, [0]
    for v in front:
        for by in (1, 5, 25, 125, 600, -1, -5, -25, -125, -600):
            if (v + by) % n not in hops:
                hops[(v + by) % n] = hops[v] + 1
                front.append((v + by) % n)
    sizes, real = [], graph.cut

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    monkeypatch.setattr(graph, "shortest_paths", None)
    want = (n - 1, round((n - 1) / sum(hops.values()), 9))
    got = {r["id"]: (r["reached"], round(r["closeness"], 9)) for r in graph.closeness(e, graph.vertices(e)).collect()}
    assert got == dict.fromkeys(range(n), want)
    assert max(sizes[1:]) <= 2 * n  # the first table is of edges
    few = graph.closeness(e, graph.vertices(e).filter("id % 700 = 3")).collect()
    assert {r["id"]: (r["reached"], round(r["closeness"], 9)) for r in few} == dict.fromkeys((3, 703, 1403), want)


def test_closeness_of_all_vertices_beyond_64_sources(spark):
    n = 150
    e = edge_table(spark, [(k, (k + by) % n) for k in range(n) for by in (1, 12)])
    hops, front = {0: 0}, [0]
    for v in front:
        for by in (1, 12, -1, -12):
            if (v + by) % n not in hops:
                hops[(v + by) % n] = hops[v] + 1
                front.append((v + by) % n)
    got = {r["id"]: (r["reached"], round(r["closeness"], 9)) for r in graph.closeness(e, graph.vertices(e)).collect()}
    assert got == {k: (n - 1, round((n - 1) / sum(hops.values()), 9)) for k in range(n)}


def most_rows(monkeypatch):
    """Rows of each table that an operator writes."""
    sizes, real = [0], graph.cut

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    return sizes


def test_betweenness_of_a_ring_moves_many_sources_a_row(spark, monkeypatch):
    n, sizes = 24, most_rows(monkeypatch)
    e = edge_table(spark, [(k, (k + 1) % n) for k in range(n)])
    got = {r["id"]: round(r["betweenness"], 9) for r in graph.betweenness(e, graph.vertices(e)).collect()}
    assert got == dict.fromkeys(range(n), 2.0 * sum(range(n // 2 - 1)) + n // 2 - 1)
    assert max(sizes) <= n * n / 4


def test_ranks_by_source_move_many_sources_a_row(spark, monkeypatch):
    n, rounds, sizes = 24, 20, most_rows(monkeypatch)
    e = edge_table(spark, [(k, (k + 1) % n) for k in range(n)])
    got = {(r["source"], (r["id"] - r["source"]) % n): round(r["rank"], 7) for r in graph.personalised_pagerank(e, graph.vertices(e), rounds).collect()}
    want = {k: round((0.15 if k < rounds else 1.0) * 0.85**k, 7) for k in range(rounds + 1)}
    assert got == {(s, k): v for s in range(n) for k, v in want.items()}
    assert max(sizes) <= n * (rounds + 1) / 4


def test_cycles_meet_in_the_middle(spark, monkeypatch):
    rng = random.Random(8)
    rows = sorted({(rng.randrange(9), rng.randrange(9)): rng.choice([10.0, 11.0, 12.0, 13.0]) for _ in range(60)}.items())
    amount = {(a, b): w for (a, b), w in rows}
    close = lambda x, y: 0.8 * x <= y <= 1.2 * x
    want = set()
    for n in (2, 3, 4, 5):
        for p in permutations(range(9), n):
            steps = [amount.get((p[k], p[(k + 1) % n])) for k in range(n)]
            if p[0] == min(p) and None not in steps and all(close(steps[k], steps[(k + 1) % n]) for k in range(n)):
                want.add((n, ",".join(map(str, p))))
    table = spark.createDataFrame([(a, b, w) for (a, b), w in rows], "src long, dst long, amount double")
    for e in (table, table.unionByName(table)):
        got = graph.cycles(e, 2, 5)
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(want) and set(found) == want
    monkeypatch.setattr(graph.DataFrame, "distinct", None)
    assert graph.cycles(table, 3, 4).count() > 0


def test_dbscan_meets_points_of_one_place_once(spark, monkeypatch):
    from tessera.operators import learning

    sizes, real = [], learning.cut

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(learning, "cut", counted)
    spots = [[0.0, 0.0], [0.2, 0.0], [0.55, 0.0], [3.0, 3.0], [9.0, 9.0]]
    rows = [(1000 - k, spots[k % 4]) for k in range(400)] + [(2000, spots[4]), (2001, [9.1, 9.0])]
    got = {r["id"]: (r["label"], r["prediction"]) for r in learning.dbscan(spark.createDataFrame(rows, "id long, vec array<double>"), 0.3, 5).collect()}
    least = [min(i for i, v in rows if v == s) for s in spots]
    label = {0: min(least[0], least[1]), 1: min(least[0], least[1]), 2: least[2], 3: least[3]}
    assert got == {i: (label[spots.index(v)], 0) for i, v in rows[:400]} | {2000: (None, -1), 2001: (None, -1)}
    assert max(sizes) < 20


@pytest.mark.parametrize("loop", [G.connected_components, G.core_numbers, lambda e: G.label_propagation(e, 2)])
def test_a_loop_over_vertices_sends_no_table_to_the_driver(spark, monkeypatch, loop):
    plans = []

    def watched(df, cut=G.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(G, "cut", watched)
    assert loop(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, 8)], "src long, dst long")).count() == 6
    assert sum("SortMergeJoin" in p for p in plans) > 1
    assert not any("Broadcast" in p for p in plans)


def test_a_task_of_a_loop_gets_no_more_rows_as_a_graph_grows(spark, monkeypatch):
    from tessera.functions import storage

    monkeypatch.setattr(storage, "EACH", 8)
    few, many = (spark.createDataFrame([(k, k + 1) for k in range(n)], "src long, dst long") for n in (10, 100))
    assert [G._kept_steps(e)[1] for e in (few, many)] == [4, 25]


def test_neighbouring_lines_meet_without_a_join_of_the_lines(spark, tmp_path):
    from tessera.plans import tables as T

    rows = [(1, 1, 10, 5, 1.0), (1, 2, 11, 6, 2.0), (1, 2, 12, 6, 3.0), (1, 4, 13, 7, 4.0), (2, 3, 14, 5, 5.0), (2, 4, 10, 8, 6.0), (2, 5, None, 9, 7.0), (None, 1, 10, 5, 1.0), (None, 2, 11, 6, 1.0), (3, None, 10, 5, 1.0), (3, None, 11, 6, 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs, flows = T.together(spark, str(tmp_path)), T.supply_graph(spark, str(tmp_path))
    assert sorted(map(tuple, pairs.collect())) == [(10, 11), (10, 12), (10, 14)]
    assert sorted(map(tuple, flows.collect())) == [(5, 6, 2.0), (5, 8, 5.0), (8, 9, 6.0)]
    for df in (pairs, flows):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("FileScan") < 3


def test_edges_are_worked_out_once(spark, tmp_path):
    from tessera.plans import tables as T

    spark.createDataFrame([(1, 7), (2, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 3, 1.0), (1, 3, 1.0), (2, 3, 1.0)], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = T.purchase_graph(spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert sorted(map(tuple, found.collect())) == [(7, 14, 2), (7, 16, 1), (14, 7, 2), (16, 7, 1)]
    edges = found.filter("src < dst")
    parts = G.modularity(edges, G.cut(G.vertices(edges).withColumn("community", F.col("id") % 2)), "weight")
    assert "orders.parquet" not in parts._jdf.queryExecution().executedPlan().toString()
