"""Graph operators over edge tables (src, dst[, weight]) of long ids.

Loops cut their lineage with a written table at each round, and keep one table of state by vertex.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.storage import cut, parts_of
from tessera.operators import blocks


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges with src < dst and without loops."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select(F.explode(F.array(F.struct("src", "dst"), back)).alias("e")).select("e.src", "e.dst").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def _kept_steps(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges both ways, dealt by their source once and kept, and into how many parts: a round shuffles its messages only."""
    steps = cut(both_ways(edges))
    parts = parts_of(steps)
    return steps.repartition(parts, "src").persist(), parts


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.count("*").alias("degree"))


def pagerank(edges: DataFrame, rounds: int = 10, reset: float = 0.15, tolerance: float | None = None, weight: str | None = None, seeds: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """id, rank: not normalised, starting at 1; the rank of vertices without out-edges is not redistributed.

    With ``tolerance`` rounds go on, however many, until no rank moves by more. ``weight`` names a column of shares; ``seeds`` (id)
    are where the reset goes (a trust or personalised rank; others start at 0); ``start`` (id, rank) are ranks to
    begin from, as when edges were added to a ranked graph. Edges and vertices are dealt and sorted by vertex once and kept,
    so that a round shuffles its messages only, and sorts no edges.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = edges.select("src", "dst", *([F.col(weight).cast("double").alias("w")] if weight else [])).repartition(n, "src").sortWithinPartitions("src").persist()
    out = steps.groupBy("src").agg((F.sum("w") if weight else F.count("*").cast("double")).alias("total"))
    # an edge carries its weight, and the sum of its source's comes with the rank, so that edges are shuffled once
    nodes = vertices(steps).join(out, F.col("id") == F.col("src"), "left").select("id", F.lit(1.0).alias("base"), "total")
    if seeds is not None:
        nodes = nodes.drop("base").join(seeds.select("id").distinct().withColumn("base", F.lit(1.0)), "id", "left").fillna(0.0, ["base"])
    nodes = cut(nodes).repartition(n, "id").sortWithinPartitions("id").persist()
    ranks = nodes.select("id", F.col("base").alias("rank"))
    if start is not None:
        ranks = nodes.join(start.select("id", F.col("rank").alias("old")), "id", "left").select("id", F.coalesce("old", "base").alias("rank"))
    value = F.col("w") if weight else F.lit(1.0)
    for turn in range(rounds) if tolerance is None else count():
        sends = nodes.select("id", "total").join(ranks, "id")
        got = steps.join(sends.hint("merge"), steps["src"] == sends["id"]).select("dst", (value / F.col("total") * F.col("rank")).alias("part")).groupBy("dst").agg(F.sum("part").alias("got"))
        new = nodes.join(got, nodes["id"] == got["dst"], "left").select("id", (reset * F.col("base") + (1 - reset) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if tolerance is None and turn % 5 < 4:
            ranks = new
            continue
        new = cut(new)
        if tolerance is not None and (new.join(ranks.withColumnRenamed("rank", "old"), "id").agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) <= tolerance:
            ranks = new
            break
        ranks = new
    ranks = cut(ranks)
    steps.unpersist()
    nodes.unpersist()
    return ranks


def pagerank_update(edges: DataFrame, ranks: DataFrame, added: DataFrame, removed: DataFrame | None = None, reset: float = 0.15, tolerance: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """id, rank of a graph that has changed, from the settled ranks before; and id of the vertices that were touched.

    edges, added, removed: src, dst (a removed edge goes with all its repeats). ranks: id, rank as ``pagerank`` with a
    tolerance gives them. What a vertex whose edges changed sends anew, less what it sent before, is a change of rank that
    moves on along edges; a round joins only the vertices whose change is above ``tolerance``, whose edges it finds by
    source. The rest of the ranks is read once, at the end. A vertex that has lost all its edges keeps the reset.
    """
    removed = edges.limit(0) if removed is None else removed
    edges, added, removed = edges.select("src", "dst"), added.select("src", "dst"), cut(removed.select("src", "dst").distinct())
    changed = cut(added.select("src").union(removed.select("src")).distinct())
    now = edges.join(removed, ["src", "dst"], "left_anti").unionByName(added)
    shares = lambda rows: rows.join(rows.groupBy("src").agg((1 / F.count("*")).alias("share")), "src")
    before, after = (shares(rows.join(changed, "src", "left_semi")) for rows in (edges, now))
    sent = after.select("src", "dst", "share").unionByName(before.select("src", "dst", (-F.col("share")).alias("share")))
    moved = sent.join(ranks, sent["src"] == ranks["id"]).select(F.col("dst").alias("id"), ((1 - reset) * F.col("share") * F.col("rank")).alias("r"))
    fresh = vertices(added).join(ranks, "id", "left_anti")
    start = fresh.select("id", F.lit(float(reset)).alias("r"))
    left = cut(moved.unionByName(start).groupBy("id").agg(F.sum("r").alias("r")))
    every = cut(shares(now))
    gained: list[DataFrame] = []
    while True:
        front = left.filter(F.abs("r") > tolerance)
        if front.isEmpty():
            break
        gained.append(front)
        passed = every.join(front, every["src"] == front["id"]).select(F.col("dst").alias("id"), ((1 - reset) * F.col("share") * F.col("r")).alias("r"))
        left = cut(left.filter(F.abs("r") <= tolerance).unionByName(passed).groupBy("id").agg(F.sum("r").alias("r")))
    if not gained:
        return ranks.select("id", "rank"), ranks.select("id").limit(0)
    whole = cut(reduce(DataFrame.unionByName, gained).groupBy("id").agg(F.sum("r").alias("r")))
    total = ranks.select("id", "rank").unionByName(whole.select("id", F.col("r").alias("rank"))).unionByName(fresh.select("id", F.lit(0.0).alias("rank")))
    return total.groupBy("id").agg(F.sum("rank").alias("rank")), whole.select("id")


def personalised_pagerank(edges: DataFrame, sources: DataFrame, rounds: int = 10, reset: float = 0.15) -> DataFrame:
    """source, id, rank: a ranking for each of ``sources`` (id), whose rank starts at 1 and takes all of the reset.

    Only vertices that a source's rank has reached have a row. Tasks that hold the edges take the rounds of their sources;
    where edges are too many, or sources few, ranks are shuffled, WIDTH sources a row.
    """
    steps, sources = cut(edges.select("src", "dst")), cut(sources.select("id").distinct())
    if blocks.fits(steps, sources):
        return blocks.Held(steps, sources).spread(sources, lambda graph, own: blocks.ranks(graph, own, rounds, reset), "source long, id long, rank double")
    out = steps.groupBy("src").agg(F.count("*").alias("total"))
    shares = cut(steps.join(out, "src").groupBy("src", "dst").agg((F.count("*") * (1 / F.first("total"))).alias("share")))
    of, members = _dealt(sources, WIDTH)
    start = cut(_starts(of))
    ranks = start
    for _ in range(rounds):
        sent = shares.join(ranks.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "block", *(((1 - reset) * F.col("share") * F.col(c)).alias(c) for c in LANES))
        again = start.select("id", "block", *((F.col(c) * float(reset)).alias(c) for c in LANES))
        ranks = cut(sent.unionByName(again).groupBy("id", "block").agg(*(F.sum(c).alias(c) for c in LANES)))
    return _unpacked(ranks, members, "rank")


def pagerank_of_adjacency(lists: DataFrame, rounds: int = 10, reset: float = 0.15, sources_only: bool = False) -> DataFrame:
    """id, rank from rows (src, pr, dsts): ranks start at ``pr``, those of vertices without a row at 1.

    With ``sources_only`` vertices without a row have no rank.
    """
    edges = lists.select("src", F.explode("dsts").alias("dst"))
    ranks = pagerank(edges, rounds, reset, start=lists.select(F.col("src").alias("id"), F.col("pr").alias("rank")))
    return ranks.join(lists.select(F.col("src").alias("id")), "id", "left_semi") if sources_only else ranks


def _dealt(sources: DataFrame, width: int, blocks: int = 1) -> tuple[DataFrame, DataFrame]:
    """id, block, bit of each different source, ``width`` of neighbouring ids to a block; and block, ids in the order of bits.

    A part begins ``blocks`` anew, so parts are few enough for most of them to be full.
    """
    ids = cut(sources.select("id").distinct())
    n = max(1, min(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), ids.count() // (8 * width * blocks)))
    placed = cut(ids.repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("n", F.monotonically_increasing_id()))
    of = placed.select("id", F.expr(f"n div {width}").alias("block"), (F.col("n") % width).cast("int").alias("bit"))
    return of, cut(of.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("bit", "id"))), lambda x: x["id"]).alias("ids")))


#: Sources whose numbers share a row, a column each.
WIDTH = 16
LANES = [f"s{k}" for k in range(WIDTH)]


def _starts(of: DataFrame) -> DataFrame:
    """id, block and a column for each source of the block: 1 at the source itself, else null."""
    return of.select("id", "block", *(F.when(F.col("bit") == k, 1.0).alias(c) for k, c in enumerate(LANES)))


def _unpacked(rows: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """source, id and the number that is not null for each source of the rows' blocks."""
    pairs = F.arrays_zip(F.col("ids").alias("source"), F.array(*LANES).alias(name))
    return rows.join(members, "block").select(F.explode(pairs).alias("x"), "id").select("x.source", "id", f"x.{name}").filter(f"{name} is not null")


#: Numbers of 64 bits that share a row of sources that reached a vertex.
WORDS = 16
BITS = [f"b{k}" for k in range(WORDS)]


def _fronts(steps: DataFrame, sources: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """id, block, word, distance of the sources that first reach a vertex at that distance; and block, ids in the order of bits.

    Each round expands the newest frontier only. Edges are dealt by their source once; a round's tasks put together what
    they send before they shuffle it, which is the table of bits at most once a task, however many the edges are.
    """
    parts = parts_of(steps)
    steps = steps.repartition(parts, "src").persist()
    of, members = _dealt(sources, 64, WORDS)
    own = lambda k: F.bit_or(F.when(F.col("block") % WORDS == k, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0)))
    starts = of.groupBy("id", F.expr(f"block div {WORDS}").alias("row")).agg(*(own(k).alias(c) for k, c in enumerate(BITS)))
    seen = cut(starts.select("id", "row", *BITS, *(F.col(c).alias(f"k{c}") for c in BITS)))
    some = reduce(lambda x, y: x | y, (F.col(c) != 0 for c in BITS))
    # where every source has reached every vertex, no round more is needed to find that out
    most_bits = of.count() * vertices(steps).union(of.select("id")).distinct().count()
    held = sum((F.bit_count(f"k{c}") for c in BITS), F.lit(0))
    found = [seen.select("id", "row", *BITS, F.lit(0).alias("distance"))]
    for hop in count(1) if most is None else range(1, most + 1):
        front = seen.filter(some).select(F.col("id").alias("at"), "row", *BITS)
        sent = steps.join(front.hint("merge"), steps["src"] == front["at"])
        got = sent.groupBy(F.col("dst").alias("id"), "row").agg(*(F.bit_or(c).alias(f"g{c}") for c in BITS))
        grown = seen.drop(*BITS).join(got.hint("merge"), ["id", "row"], "full")
        known, came = ([F.coalesce(f"{x}{c}", F.lit(0)) for c in BITS] for x in "kg")
        seen = cut(grown.select("id", "row", *(g.bitwiseAND(F.bitwise_not(k)).alias(c) for k, g, c in zip(known, came, BITS, strict=True)), *(k.bitwiseOR(g).alias(f"k{c}") for k, g, c in zip(known, came, BITS, strict=True))))
        fresh, reached = seen.agg(F.count_if(some), F.sum(held)).first()
        if fresh:
            found.append(seen.filter(some).select("id", "row", *BITS, F.lit(hop).alias("distance")))
        if not fresh or reached == most_bits:
            break
        if len(found) > 50:
            found = [cut(reduce(DataFrame.unionByName, found))]
    steps.unpersist()
    every = reduce(DataFrame.unionByName, found).select("id", "distance", "row", F.posexplode(F.array(*BITS)).alias("k", "word"))
    return every.filter("word <> 0").select("id", (F.col("row") * WORDS + F.col("k")).alias("block"), "word", "distance"), members


def shortest_paths(edges: DataFrame, sources: DataFrame, most: int | None = None, directed: bool = True) -> DataFrame:
    """source, id, distance in hops, all of them unless ``most`` is given.

    The sources that have reached a vertex are bits. Tasks that hold the edges take the rounds of their sources; where edges
    are too many, or sources few, bits are shuffled, 64 to a number and WORDS numbers to a row, so that a round's rows
    are edges by rows of sources.
    """
    steps, sources = cut(edges.select("src", "dst").distinct() if directed else both_ways(edges)), cut(sources.select("id").distinct())
    if blocks.fits(steps, sources):
        return blocks.Held(steps, sources).spread(sources, lambda graph, own: blocks.distances(graph, own, most), "source long, id long, distance int")
    found, members = _fronts(steps, sources, most)
    every = found.join(members, "block")
    return every.select(F.explode(F.expr("filter(transform(ids, (x, k) -> if(getbit(word, k) = 1, struct(x as source), null)), x -> x is not null)")).alias("x"), "id", "distance").select("x.source", "id", "distance")


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that can be reached, by smallest labels and labels' labels."""
    steps, _ = _kept_steps(edges)
    labels = cut(steps.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = steps.join(labels.hint("merge"), steps["src"] == labels["id"]).groupBy("dst").agg(F.min("component").alias("best"))
        lower = cut(labels.join(near.hint("merge"), labels["id"] == near["dst"], "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("best", "component")).alias("component")))
        target = lower.select(F.col("id").alias("at"), F.col("component").alias("further"))
        new = cut(lower.join(target.hint("merge"), lower["component"] == target["at"]).select("id", "old", F.least("component", "further").alias("component")))
        labels = new.drop("old")
        if new.filter("component <> old").isEmpty():
            steps.unpersist()
            return labels


def strongly_connected_components(edges: DataFrame) -> DataFrame:
    """id, component (smallest member): colour forward by the smallest id, then collect each colour backward."""
    rest = cut(edges.select("src", "dst").distinct())
    left = cut(vertices(edges))
    found = None
    while left.limit(1).count():
        colour = cut(left.withColumn("colour", F.col("id")))
        while True:
            got = rest.join(colour, rest["src"] == colour["id"]).groupBy("dst").agg(F.min("colour").alias("best"))
            new = cut(colour.join(got, colour["id"] == got["dst"], "left").select("id", F.least("colour", F.coalesce("best", "colour")).alias("colour")))
            done = not new.join(colour.withColumnRenamed("colour", "old"), "id").filter("colour <> old").limit(1).count()
            colour = new
            if done:
                break
        inside = cut(rest.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("c2")), "dst").filter("c1 = c2").select("src", "dst"))
        members = cut(colour.filter("id = colour"))
        while True:
            back = inside.join(members, inside["dst"] == members["id"]).select(F.col("src").alias("id"), "colour").distinct().join(members, "id", "left_anti")
            grown = cut(members.unionByName(back))
            if not grown.join(members, "id", "left_anti").limit(1).count():
                break
            members = grown
        found = members if found is None else found.unionByName(members)
        left = cut(left.join(members, "id", "left_anti"))
        rest = cut(rest.join(members.select(F.col("id").alias("src")), "src", "left_anti").join(members.select(F.col("id").alias("dst")), "dst", "left_anti"))
    return (found if found is not None else left.withColumn("colour", F.col("id"))).withColumnRenamed("colour", "component")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, label: each round the commonest label of the neighbours, of several the smallest."""
    steps, parts = _kept_steps(edges)
    labels = steps.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        heard = steps.join(labels.hint("merge"), steps["src"] == labels["id"]).select("dst", "label").repartition(parts, "dst")
        votes = heard.groupBy("dst", "label").agg(F.count("*").alias("n"))
        labels = cut(votes.groupBy("dst").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b")).select(F.col("dst").alias("id"), (-F.col("b.l")).alias("label")))
    if rounds:
        steps.unpersist()
    return labels


def modularity(edges: DataFrame, communities: DataFrame, weight: str | None = None, directed: bool = False) -> DataFrame:
    """One row, modularity, of edges and (id, community).

    Loops are left out. Repeated edges (undirected: either way) count once, or with ``weight`` add up (null: 0). With
    ``directed`` the expected weight is by what leaves one community's vertices and enters the other's.
    """
    if weight:
        w = F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0))
        ends = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
        pairs = edges.filter("src <> dst").groupBy(ends[0].alias("src"), ends[1].alias("dst")).agg(F.sum(w).alias("w"))
    else:
        pairs = (edges.filter("src <> dst").select("src", "dst").distinct() if directed else undirected(edges)).withColumn("w", F.lit(1.0))
    pairs, c = cut(pairs), communities.select("id", "community")
    pairs = pairs.repartition(parts_of(pairs), "src")
    inside = pairs.join(c.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    within = inside.filter("a = b").groupBy("a").agg(F.sum("w").alias("within"))
    ends = pairs.select(F.col("src").alias("id"), F.col("w").alias("o"), F.lit(0.0).alias("i")).union(pairs.select("dst", F.lit(0.0), "w"))
    total = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).join(c, "id").groupBy("community").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    parts = total.join(within, total["community"] == within["a"], "left").join(F.broadcast(pairs.agg(F.sum("w").alias("m"))))
    expected = F.col("o") * F.col("i") / F.pow("m", F.lit(2.0)) if directed else F.pow((F.col("o") + F.col("i")) / (2 * F.col("m")), F.lit(2.0))
    return parts.agg(F.sum(F.coalesce("within", F.lit(0.0)) / F.col("m") - expected).alias("modularity"))


def _oriented(edges: DataFrame) -> DataFrame:
    """Undirected edges from the end of lower degree to the other, which bounds the wedges at hot vertices."""
    pairs = cut(undirected(edges))
    d = degrees(pairs).select("id", "degree")
    ranked = pairs.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    swap = (F.col("ds") > F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") > F.col("dst")))
    return cut(ranked.select(F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("b")))


def triangles(edges: DataFrame) -> DataFrame:
    """id, triangles of every vertex."""
    o = _oriented(edges)
    wedge = o.join(o.select("a", F.col("b").alias("c")), "a").filter("b < c")
    closed = wedge.join(undirected(edges), (F.col("b") == F.col("src")) & (F.col("c") == F.col("dst"))).select("a", "b", "c")
    n = closed.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    return vertices(edges).join(n, "id", "left").fillna(0, ["triangles"])


def clustering(edges: DataFrame) -> DataFrame:
    """id, degree, triangles, coefficient (0 below degree 2)."""
    d = degrees(undirected(edges)).select("id", "degree")
    return d.join(triangles(edges), "id").withColumn("coefficient", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def core_numbers(edges: DataFrame) -> DataFrame:
    """id, core: each round the h-index of the neighbours' estimates, from counts by value, until none falls."""
    steps, parts = _kept_steps(edges.filter("src <> dst"))
    core = cut(steps.groupBy(F.col("src").alias("id")).agg(F.count("*").cast("long").alias("core")))
    while True:
        heard = steps.join(core.hint("merge"), steps["src"] == core["id"]).select("dst", "core").repartition(parts, "dst")
        near = heard.groupBy("dst", "core").agg(F.count("*").alias("n"))
        above = near.withColumn("least", F.sum("n").over(Window.partitionBy("dst").orderBy(F.desc("core"))))
        h = above.groupBy("dst").agg(F.max(F.least("core", "least")).alias("h"))
        new = cut(core.join(h.hint("merge"), core["id"] == h["dst"]).select("id", F.col("core").alias("old"), F.least("core", "h").alias("core")))
        core = new.drop("old")
        if new.filter("core <> old").isEmpty():
            steps.unpersist()
            return core


def closeness(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """id, reached, closeness = reached / sum of distances, of the given vertices over undirected hops.

    Vertices are counted by bit of the sources, no row stands for a pair. Tasks that hold the edges take the rounds of their
    sources; where edges are too many, or sources few, bits are shuffled.
    """
    steps, sources = cut(both_ways(edges)), cut(sources.select("id").distinct())
    if blocks.fits(steps, sources):
        sums = blocks.Held(steps, sources).spread(sources, lambda graph, own: blocks.reaches(graph, own, most), "id long, reached long, total long")
        return sums.filter("reached > 0").select("id", "reached", (F.col("reached") / F.col("total")).alias("closeness"))
    found, members = _fronts(steps, sources, most)
    bits = found.filter("distance > 0").groupBy("block", "distance").agg(*(F.sum(F.getbit("word", F.lit(k)).cast("long")).alias(f"n{k}") for k in range(64)))
    by_bit = bits.join(members, "block").select("distance", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.slice(F.array(*(f"n{k}" for k in range(64))), 1, F.size("ids")).alias("n"))).alias("x"))
    return by_bit.filter("x.n > 0").groupBy("x.id").agg(F.sum("x.n").alias("reached"), (F.sum("x.n") / F.sum(F.col("distance") * F.col("x.n"))).alias("closeness"))


def _weighed(edges: DataFrame, weight: str, directed: bool) -> tuple[DataFrame, float | None]:
    """src, dst, w without loops, of repeated edges the least, none negative; and the mean weight."""
    value = F.col(f"`{weight}`").cast("double")
    steps = edges.select("src", "dst", value.alias("w")).filter("w is not null and src <> dst")
    if not directed:
        steps = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    steps = cut(steps.groupBy("src", "dst").agg(F.min("w").alias("w")))
    least, mean = steps.agg(F.min("w"), F.avg("w")).first()
    if least is not None and least < 0:
        raise ValueError("a weight is negative")
    return steps, mean


def weighted_paths(edges: DataFrame, sources: DataFrame, weight: str, width: float | None = None, directed: bool = True) -> DataFrame:
    """source, id, distance: least sums of weights from each of ``sources`` (id), by bucketed relaxation.

    Tasks that hold the edges take their sources one by one. Where edges are too many, or sources few, or a ``width`` is
    given, distances are shuffled: they are taken in buckets of ``width`` (by default the mean weight): only vertices of the nearest bucket whose
    distance has fallen send it on, until the bucket is settled, so that a far vertex is seldom reached too dearly. Weights
    must not be negative (ValueError); edges with a null weight are left out, and of repeated edges the least counts.
    """
    steps, mean = _weighed(edges, weight, directed)
    if width is None and blocks.fits(steps, ids := cut(sources.select("id").distinct())):
        return blocks.Held(steps, ids, onward=True, weighted=True).spread(ids, blocks.weighted_distances, "source long, id long, distance double")
    width = width or mean or 1.0
    # "fresh" marks distances that have not been sent on
    seen = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance"), F.lit(True).alias("fresh")).distinct())
    while True:
        nearest = seen.filter("fresh").agg(F.min("distance")).first()[0]
        if nearest is None:
            return seen.drop("fresh")
        bound = (math.floor(nearest / width) + 1) * width
        sends = F.col("fresh") & (F.col("distance") < max(bound, math.nextafter(nearest, math.inf)))
        got = seen.filter(sends).join(steps, F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
        both = seen.withColumn("sent", sends).join(got, ["source", "id"], "full")
        better = F.col("offer").isNotNull() & (F.col("distance").isNull() | (F.col("offer") < F.col("distance")))
        seen = cut(both.select("source", "id", F.when(better, F.col("offer")).otherwise(F.col("distance")).alias("distance"), F.when(better, True).otherwise(F.col("fresh") & ~F.col("sent")).alias("fresh")))


def weighted_closeness(edges: DataFrame, sources: DataFrame, weight: str, width: float | None = None, directed: bool = True) -> DataFrame:
    """id, reached, closeness = reached / sum of weighted distances; null where those are all 0."""
    steps, _ = _weighed(edges, weight, directed)
    if width is None and blocks.fits(steps, ids := cut(sources.select("id").distinct())):
        sums = blocks.Held(steps, ids, onward=True, weighted=True).spread(ids, blocks.weighted_reaches, "id long, reached long, total double")
        return sums.filter("reached > 0").select("id", "reached", F.try_divide(F.col("reached").cast("double"), F.col("total")).alias("closeness"))
    d = weighted_paths(edges, sources, weight, width, directed).filter("source <> id")
    return d.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("reached"), F.try_divide(F.count("*").cast("double"), F.sum("distance")).alias("closeness"))


def betweenness(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """id, betweenness: shortest-path dependencies of the given sources (all vertices: exact), over undirected hops.

    Paths are counted outwards and dependencies summed inwards, by tasks that hold the edges; where edges are too many, or
    sources few, counts are shuffled, WIDTH sources a row.
    """
    steps, sources = cut(both_ways(edges)), cut(sources.select("id").distinct())
    if blocks.fits(steps, sources):
        sums = blocks.Held(steps, sources).spread(sources, lambda graph, own: blocks.dependencies(graph, own, most), "id long, own double")
        return sums.groupBy("id").agg(F.sum("own").alias("betweenness"))
    of, _ = _dealt(sources, WIDTH)
    bits = lambda: sum((F.when(F.col(c).isNotNull(), F.lit(1 << k)).otherwise(0) for k, c in enumerate(LANES)), F.lit(0))
    fronts = [cut(_starts(of))]
    known = cut(fronts[0].select("id", "block", bits().alias("known")))
    for _ in count(1) if most is None else range(most):
        front = fronts[-1].withColumnRenamed("id", "src")
        got = steps.join(front, "src").groupBy(F.col("dst").alias("id"), "block").agg(*(F.sum(c).alias(c) for c in LANES)).join(known, ["id", "block"], "left")
        new = got.select("id", "block", *(F.when(F.coalesce("known", F.lit(0)).bitwiseAND(F.lit(1 << k)) == 0, F.col(c)).alias(c) for k, c in enumerate(LANES)))
        new = cut(new.filter(F.coalesce(*LANES).isNotNull()))
        if new.isEmpty():
            break
        fronts.append(new)
        known = cut(known.unionByName(new.select("id", "block", bits().alias("known"))).groupBy("id", "block").agg(F.sum("known").alias("known")))
    found, below = [], None
    for front in reversed(fronts[1:]):
        delta = front.select("id", "block", *(F.col(c).alias(f"p{k}") for k, c in enumerate(LANES)))
        if below is not None:
            got = steps.join(below.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "block").agg(*(F.sum(c).alias(c) for c in LANES))
            delta = delta.join(got, ["id", "block"], "left")
        else:
            delta = delta.withColumns({c: F.lit(None).cast("double") for c in LANES})
        # a path's part of the dependency of each vertex before it, and this vertex's own dependency
        part = [F.when(F.col(f"p{k}").isNotNull(), F.coalesce(F.col(f"p{k}") * F.col(c), F.lit(0.0))) for k, c in enumerate(LANES)]
        own = sum((F.coalesce(x, F.lit(0.0)) for x in part), F.lit(0.0))
        below = cut(delta.select("id", "block", own.alias("own"), *(((1 + x) / F.col(f"p{k}")).alias(c) for k, (c, x) in enumerate(zip(LANES, part, strict=True)))))
        found.append(below.select("id", "own"))
        below = below.drop("own")
        if len(found) > 50:
            found = [cut(reduce(DataFrame.unionByName, found))]
    every = reduce(DataFrame.unionByName, found) if found else fronts[0].limit(0).select("id", F.lit(0.0).alias("own"))
    return every.groupBy("id").agg(F.sum("own").alias("betweenness"))


def cycles(edges: DataFrame, shortest: int = 3, longest: int = 4, least: float = 0.8, most: float = 1.2) -> DataFrame:
    """Simple directed cycles whose neighbouring amounts have a ratio in [least, most]; each once, from its smallest id.

    edges: src, dst, amount. Returns length, path. Two halves meet at the vertex in the middle, so that no path of more
    than half of ``longest`` is ever listed unless it closes.
    """
    e = cut(edges.filter("src <> dst").select("src", "dst", "amount"))
    step = e.select(F.col("src").alias("s"), F.col("dst").alias("t"), F.col("amount").alias("next"))
    ratio = lambda a, b: (b >= a * least) & (b <= a * most)
    # halves of cycles, from the smallest id to a meeting vertex and from there back; neither half has the meeting vertex in its path
    out = {1: e.filter("src < dst").select(F.col("src").alias("root"), F.array().cast("array<bigint>").alias("path"), F.col("dst").alias("meet"), F.col("amount").alias("first"), F.col("amount").alias("last"))}
    back = {1: e.filter("dst < src").select(F.col("dst").alias("root"), F.array().cast("array<bigint>").alias("path"), F.col("src").alias("meet"), F.col("amount").alias("first"), F.col("amount").alias("last"))}
    for n in range(1, (longest + 1) // 2):
        reached = out[n].join(step, F.col("meet") == F.col("s")).filter(ratio(F.col("last"), F.col("next")) & (F.col("t") > F.col("root")) & (F.col("t") != F.col("meet")) & ~F.array_contains("path", F.col("t")))
        out[n + 1] = reached.select("root", F.concat("path", F.array("meet")).alias("path"), F.col("t").alias("meet"), "first", F.col("next").alias("last"))
    for n in range(1, longest // 2):
        reached = back[n].join(step, F.col("meet") == F.col("t")).filter(ratio(F.col("next"), F.col("first")) & (F.col("s") > F.col("root")) & (F.col("s") != F.col("meet")) & ~F.array_contains("path", F.col("s")))
        back[n + 1] = reached.select("root", F.concat(F.array("meet"), "path").alias("path"), F.col("s").alias("meet"), F.col("next").alias("first"), "last")
    found = None
    for length in range(shortest, longest + 1):
        here = out[(length + 1) // 2]
        there = back[length // 2].select("root", "meet", F.col("path").alias("rest"), F.col("first").alias("onward"), F.col("last").alias("home"))
        met = here.join(there, ["root", "meet"]).filter(ratio(F.col("last"), F.col("onward")) & ratio(F.col("home"), F.col("first")) & ~F.arrays_overlap("path", "rest"))
        closed = met.select(F.lit(length).alias("length"), F.array_join(F.concat(F.array("root"), "path", F.array("meet"), "rest"), ",").alias("path"))
        found = closed if found is None else found.unionByName(closed)
    # without repeated edges a cycle is found once
    return found.distinct() if not e.groupBy("src", "dst").count().filter("count > 1").isEmpty() else found


def squares(edges: DataFrame) -> DataFrame:
    """id, squares: closed walks over four different vertices that begin at each vertex, which are twice the cycles of four
    edges through it; vertices without one have no row.

    A cycle is met at its highest vertex, by degree and then by id: two lower neighbours share a lower vertex opposite. So
    only paths of two edges below their end are shuffled, and no hub's neighbours are paired with each other.
    """
    pairs = cut(undirected(edges))
    d = degrees(pairs).select("id", "degree")
    steps = pairs.union(pairs.select("dst", "src"))
    near = cut(steps.join(d, F.col("dst") == F.col("id")).select("src", "dst", "degree"))
    above = near.select(F.col("src").alias("id"), F.col("dst").alias("top"), F.col("degree").alias("dt")).join(d, "id").filter("dt > degree or dt = degree and top > id")
    below = near.select(F.col("src").alias("id"), F.col("dst").alias("low"), F.col("degree").alias("dl"))
    paths = above.join(below, "id").filter("dt > dl or dt = dl and top > low").select("id", "top", "low")
    shared = paths.withColumn("n", F.count("*").over(Window.partitionBy("top", "low")) - 1).filter("n > 0")
    ends = shared.select(F.explode(F.array(F.struct("id", (2 * F.col("n")).alias("n")), F.struct(F.col("top").alias("id"), "n"), F.struct(F.col("low").alias("id"), "n"))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.n").alias("squares"))


def match_subgraph(edges: DataFrame, pattern: list[tuple[int, int]]) -> DataFrame:
    """All injective matches of an undirected pattern (edges of vertex numbers, each joined to an earlier one)."""
    steps = cut(both_ways(edges.filter("src <> dst")))
    first, *rest = pattern
    rows, known = steps.select(F.col("src").alias(f"v{first[0]}"), F.col("dst").alias(f"v{first[1]}")), [first[0], first[1]]
    for u, v in rest:
        u, v = (u, v) if u in known else (v, u)
        if v in known:
            rows = rows.join(steps.select(F.col("src").alias(f"v{u}"), F.col("dst").alias(f"v{v}")), [f"v{u}", f"v{v}"], "left_semi")
        else:
            rows = rows.join(steps.select(F.col("src").alias(f"v{u}"), F.col("dst").alias(f"v{v}")), f"v{u}")
            for k in known:
                rows = rows.filter(F.col(f"v{k}") != F.col(f"v{v}"))
            known.append(v)
    return rows.select(*(f"v{k}" for k in sorted(known)))
