"""Registered queries of neighbours, moments with nulls, weighted quantiles and attributions: name, (query, SQL or None)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import sketch
from tessera.functions.running import largest, neighbours_in_place, places
from tessera.functions.storage import cut
from tessera.operators import boosting as B
from tessera.operators import centres as K
from tessera.operators import lambdas as R
from tessera.operators import graph as G
from tessera.operators import learning as M
from tessera.operators import neighbours as N
from tessera.operators import sparse as X
from tessera.operators import stats as S
from tessera.operators import word_vectors as V
from tessera.plans import tables as T
from tessera.plans.graph_queries import QUERIES as GRAPHS
from tessera.plans.learning_queries import FIRST_SPLIT, NEAR, NUMERIC

WITHIN = 7.5


def within(spark, d):
    """Of each query how many of its ten nearest stand within a distance, and how far they are in all."""
    p = T.points(spark, d)
    found = N.with_neighbours(p.filter("id % 50 = 0"), N.nearest(p, p.filter("id % 50 = 0"), 10, WITHIN))
    return found.select(F.col("id").alias("query"), F.size("neighbours").alias("n"), F.round(F.aggregate("distances", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def weighted(spark, d):
    """Votes and means of seven neighbours, weighted by a number of the point."""
    p = T.points(spark, d).withColumn("w", (1 + F.col("id") % 3).cast("double"))
    near = N.nearest(p, p.filter("id % 50 = 0"), 7)
    votes, means = N.vote(near, p, "label", "w"), N.weighted_mean(near, p, "label", "w")
    return votes.join(means, "query").select("query", "label", F.round("share", 6).alias("share"), F.round("value", 6).alias("value"))


HOLED = "(SELECT nullif(l_discount, 0.0) AS a, nullif(l_tax, 0.0) AS b, l_quantity AS c FROM lineitem)"
HOLED_PAIRS = (("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c"))


def holed(spark, d):
    """Moments, correlations and rank correlations of columns with nulls, and a regression."""
    rows = T.load(spark, d, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("a"), F.nullif("l_tax", F.lit(0.0)).alias("b"), F.col("l_quantity").alias("c"))
    cols = ["a", "b", "c"]
    parts = {"covariance": S.covariance(rows, cols), "pearson": S.pearson(rows, cols), "spearman": S.spearman(rows, cols), "cosine": S.cosine_columns(rows, cols)}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("name"), "a", "b", F.round("value", 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    line = S.regression(rows, "c", "a").select(F.lit("slope").alias("name"), F.lit("a").alias("a"), F.lit("c").alias("b"), F.round("slope", 4).alias("value"))
    return out.unionByName(line)


def _holed_sql() -> str:
    made = []
    for a, b in HOLED_PAIRS:
        both = f"FROM {HOLED} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        made.append(f"SELECT 'covariance' AS name, '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 6) AS value {both}")
        made.append(f"SELECT 'pearson', '{a}', '{b}', round(corr({a}, {b}), 6) {both}")
        ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {n}" for c, n in ((a, "x"), (b, "y")))
        made.append(f"SELECT 'spearman', '{a}', '{b}', round(corr(x, y), 6) FROM (SELECT {ranks} {both})")
        if a != b:
            made.append(f"SELECT 'cosine', '{a}', '{b}', round(sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b})), 6) {both}")
    made.append(f"SELECT 'slope', 'a', 'c', round(regr_slope(c, a), 4) FROM {HOLED}")
    return " UNION ALL ".join(made)


BINS, EPS = 16, 0.002


def _weights(batch):
    return batch.column(batch.schema.get_field_index("l_tax")).to_numpy().astype(float) * 100


def weighted_cuts(spark, d):
    """Quantities at sixteenths of their weight, where all values are few enough to be held."""
    rows = T.load(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_tax").cast("double").alias("l_tax"))
    (s,) = sketch.summaries(rows, ["l_quantity"], _weights, EPS)
    at = s.nearest(np.arange(1, BINS) * s.total / BINS)
    return spark.createDataFrame([(k + 1, float(s.value[i])) for k, i in enumerate(at)], "k int, value double")


def weighted_ranks(spark, d):
    """Prices at hundredths of their weight: whether each one's exact rank is as near as promised."""
    rows = T.load(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("l_extendedprice"), F.col("l_tax").cast("double").alias("l_tax"))
    (s,) = sketch.summaries(rows, ["l_extendedprice"], _weights, EPS)
    at = s.nearest(np.arange(1, 100) * s.total / 100)
    w, x = F.col("l_tax") * 100, F.col("l_extendedprice")
    sums = [(F.sum(F.when(x < float(v), w).otherwise(0.0)).alias(f"a{k}"), F.sum(F.when(x <= float(v), w).otherwise(0.0)).alias(f"b{k}")) for k, v in enumerate(s.value[at])]
    ranks = rows.agg(F.sum(w).alias("t"), *(c for pair in sums for c in pair))
    near = [F.struct(F.lit(k + 1).alias("k"), ((F.col(f"a{k}") <= ((k + 1) / 100 + EPS) * F.col("t")) & (F.col(f"b{k}") >= ((k + 1) / 100 - EPS) * F.col("t"))).alias("near")) for k in range(99)]
    return ranks.select(F.explode(F.array(*near)).alias("r")).select("r.*")


def shapley(spark, d):
    """For each line how far its Shapley values and its interactions are from adding up to its margin."""
    rows = T.flagged(spark, d)
    model = B.boost(rows, NUMERIC, "y", B.Params(objective="logistic", rounds=3, depth=4))
    both = model.interactions(model.shapley(model.transform(rows)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return both.select("l_orderkey", "l_linenumber", F.round(F.abs(total("contributions") - F.col("margin")), 6).alias("gap"), F.round(F.abs(total(F.flatten("interactions")) - F.col("margin")), 6).alias("pair_gap"))


def shapley_of_a_split(spark, d):
    """The Shapley values of a tree of one split: the leaf's weight less the mean, for the feature that splits."""
    rows = T.flagged(spark, d)
    model = B.boost(rows, ["l_quantity", "l_discount", "l_tax"], "y", B.Params(rounds=1, depth=1))
    c = F.col("contributions")
    return model.shapley(rows).select("l_orderkey", "l_linenumber", F.round(c[0] + c[1] + c[2], 6).alias("value"), F.round(c[3], 6).alias("mean"))


def swaps(spark, d):
    """For each order: what swapping neighbours in the order of quantities changes of the gain and of the precision, in all."""
    lines = T.load(spark, d, "lineitem")
    tie = F.struct("l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    rows = lines.select(F.col("l_orderkey").alias("q"), F.when(F.col("l_returnflag") == "R", 2.0).when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0).alias("y"), F.col("l_quantity").cast("double").alias("m0"), tie.alias("u"))
    order = [F.desc("m0"), F.asc("u")]
    most = largest(rows, "q")
    placed = places(R.grouped(rows, most), "q", order, {"hits": F.when(F.col("y") > 0, 1).otherwise(0)}, most=most)
    share = lambda more: F.when(F.col("y") > 0, (F.col("hits") + more) / F.col("place")).otherwise(0.0)
    placed = places(placed, "q", order, {"acc": share(0), "add": share(1), "miss": share(-1)}, most=most)
    pairs = neighbours_in_place(placed, "q", ["y", "place", "s_ideal", "s_hits", "hits", "acc", "add", "miss"], most)
    return pairs.groupBy(F.col("q").alias("l_orderkey")).agg(F.round(F.sum(R.ndcg_change("a", "b")), 6).alias("ndcg"), F.round(F.sum(R.map_change("a", "b")), 6).alias("map"))


def _word_matrix(spark, d):
    """Documents by words: counts, with the words numbered."""
    words = T.load(spark, d, "documents").select(F.col("doc_id").alias("i"), F.explode(F.split("text", "[ \t\n\r]+")).alias("word")).filter("word <> ''")
    numbers = cut(X.numbered(words, "word", "j"))
    return words.join(numbers, "word").select("i", "j", F.lit(1.0).alias("v")), numbers.count()


def word_vectors(spark, d):
    """Of the first singular vectors of documents by words: how far A v is from sigma u, from sums over the long form."""
    entries, n = _word_matrix(spark, d)
    sigma, v, left = X.singular(X.Matrix.of(entries, n), 4)
    right = X.spread(spark, v, "j", "x")
    along = entries.join(right, "j").groupBy("i").agg(*(F.sum(F.col("x")[k]).alias(f"a{k}") for k in range(len(sigma)))).join(left, "i", "full")
    gaps = along.agg(*(F.max(F.abs(F.col(f"a{k}") - float(s) * F.col("left")[k]) / float(s)).alias(f"g{k}") for k, s in enumerate(sigma)), *(F.sum(F.col("left")[k] * F.col("left")[k]).alias(f"n{k}") for k in range(len(sigma))))
    return gaps.select(F.explode(F.array(*(F.struct(F.lit(k).alias("component"), F.lit(n).cast("long").alias("columns"), F.round(f"g{k}", 6).alias("gap"), F.round(f"n{k}", 6).alias("length")) for k in range(len(sigma))))).alias("r")).select("r.*")


def _purchases(spark, d):
    bought = T.bought(spark, d)
    users, items = X.numbered(bought, "user", "i"), cut(X.numbered(bought, "item", "j"))
    return bought.join(users, "user").join(items, "item").select("i", "j", F.col("n").cast("double").alias("v")), items


def largest_value(spark, d):
    """The largest singular value of customers by parts."""
    entries, items = _purchases(spark, d)
    sigma, _, _ = X.singular(X.Matrix.of(entries, items.count()), 1)
    return spark.createDataFrame([(float(sigma[0]),)], "sigma double").select(F.round("sigma", 4).alias("sigma"))


def similar(spark, d):
    """Parts that the same customers buy: all pairs with a cosine of at least 0.4."""
    entries, items = _purchases(spark, d)
    found = X.similar_columns(X.Matrix.of(entries, items.count()), 0.4)
    name = lambda c: items.select(F.col("j").alias(c), F.col("item").alias(f"part_{c}"))
    return found.join(name("a"), "a").join(name("b"), "b").select("part_a", "part_b", F.round("similarity", 6).alias("similarity"))


def _largest_sql(rounds: int = 30) -> str:
    """Rounds of multiplying a vector by the matrix and its transpose; the last growth is the square of the value."""
    made = ["b AS MATERIALIZED (SELECT o_custkey AS u, l_partkey AS i, count(*)::DOUBLE AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)", "v0 AS MATERIALIZED (SELECT i, 1.0::DOUBLE AS x, 1.0::DOUBLE AS s FROM b GROUP BY i)"]
    for k in range(rounds):
        made += [f"a{k} AS MATERIALIZED (SELECT u, sum(n * x) AS y FROM b JOIN v{k} USING (i) GROUP BY u)", f"w{k} AS MATERIALIZED (SELECT i, sum(n * y) AS x FROM b JOIN a{k} USING (u) GROUP BY i)", f"v{k + 1} AS MATERIALIZED (SELECT i, x / s AS x, s FROM w{k}, (SELECT sqrt(sum(x * x)) AS s FROM w{k}))"]
    return f"WITH {', '.join(made)} SELECT round(sqrt(max(s)), 4) AS sigma FROM v{rounds}"


def parallel(spark, d):
    """Whether twelve centres found in parallel, moved a few rounds, cost little more than Lloyd rounds from spread ones; points by cluster add up."""
    p = T.points(spark, d)
    start = K.parallel_centres(p, 12)
    moved = M.kmeans(p, start, 5)
    spread = M.kmeans(p, M.spread_centres(p, 12), 5)
    held = lambda c: {r["cluster"]: list(r["vec"]) for r in c.collect()}
    near = K.cost(p, held(moved)) <= 1.2 * K.cost(p, held(spread))
    return K.assign(p, held(moved)).agg(F.count("*").alias("points"), F.countDistinct("cluster").alias("clusters")).withColumn("near", F.lit(bool(near)))


def _sentences(spark, d):
    return T.load(spark, d, "documents").select(F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != "").alias("words"))


def vocabulary(spark, d):
    return V.vocabulary(_sentences(spark, d), 5)


def word_codes(spark, d):
    """Of the vocabulary's codes: words, whether they fill the tree, and whether rarer words never have shorter codes."""
    n = V.vocabulary(_sentences(spark, d), 5).orderBy("place").select("n").toArrow().column("n").to_numpy()
    _, _, lengths = V.huffman(n)
    lines = spark.createDataFrame(pa.table({"n": n, "length": lengths}))
    falls = lines.groupBy("n").agg(F.min("length").alias("a"), F.max("length").alias("b"))
    shorter = falls.withColumn("next", F.lead("a").over(Window.orderBy(F.desc("n")))).agg(F.count(F.when(F.col("next") < F.col("b"), 1)).alias("shorter"))
    return lines.agg(F.count("*").alias("words"), F.round(F.sum(F.pow(F.lit(2.0), -F.col("length"))), 9).alias("filled")).join(shorter)


def word_means(spark, d):
    """Mean vectors of documents: as many numbers as asked for, and none for documents without known words."""
    rows = T.load(spark, d, "documents").select("doc_id", F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != "").alias("words"))
    model = V.fit(rows, size=12, window=3, least=5)
    return model.transform(rows).select("doc_id", F.size("vector").alias("size"), F.exists("vector", lambda x: x != 0).alias("known"))


def updated(spark, d):
    """Ranks of the graph without some edges and with others, and then of the whole graph from those."""
    e = T.supply_graph(spark, d).select("src", "dst")
    late = (F.col("src") * 7 + F.col("dst")) % 11 == 0
    false = e.filter("src % 5 = 1").select("src", (F.col("dst") + 1_000_000).alias("dst")).distinct()
    old = e.filter(~late).unionByName(false)
    ranks, _ = G.pagerank_update(old, G.pagerank(old, reset=0.6, tolerance=1e-11), e.filter(late), false, reset=0.6, tolerance=1e-11)
    return ranks.join(G.vertices(e), "id", "left_semi").select("id", F.round("rank", 6).alias("rank"))


def weighted_closeness(spark, d):
    e = T.supply_graph(spark, d)
    return G.weighted_closeness(e, G.vertices(e), "amount").withColumn("closeness", F.round("closeness", 8))


def _weighted_closeness_sql(rounds: int = 12) -> str:
    """Rounds of relaxing all edges; more than paths here have edges."""
    made = ["e AS MATERIALIZED (SELECT src, dst, amount::DOUBLE AS w FROM edges)", "d0 AS MATERIALIZED (SELECT id AS source, id, 0.0::DOUBLE AS d FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges))"]
    for k in range(rounds):
        made.append(f"d{k + 1} AS MATERIALIZED (SELECT source, id, min(d) AS d FROM (SELECT * FROM d{k} UNION ALL SELECT source, dst, d + w FROM d{k} JOIN e ON src = id) GROUP BY 1, 2)")
    return f"WITH {T.SUPPLIES}, {', '.join(made)} SELECT source AS id, count(*) AS reached, round(count(*) / sum(d), 8) AS closeness FROM d{rounds} WHERE source <> id GROUP BY 1"


#: Neighbours at the places k and k + 1: the discounts differ by 1 / log2(k + 1) - 1 / log2(k + 2); a hit moves by one place.
SWAPS = """WITH t AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS y, row_number() OVER w AS k, row_number() OVER v AS ik FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_extendedprice, l_discount, l_tax),
v AS (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END DESC, l_linenumber, l_extendedprice, l_discount, l_tax)),
g AS (SELECT l_orderkey, sum((power(2, y) - 1) / log2(ik + 1)) AS ideal, count(*) FILTER (y > 0) AS hits FROM t GROUP BY 1),
n AS (SELECT l_orderkey, y, k, lead(y) OVER w AS z, count(*) FILTER (y > 0) OVER (PARTITION BY l_orderkey ORDER BY k) AS h FROM t WINDOW w AS (PARTITION BY l_orderkey ORDER BY k))
SELECT n.l_orderkey, round(sum(CASE WHEN ideal > 0 THEN abs(power(2, y) - power(2, z)) * (1 / log2(k + 1) - 1 / log2(k + 2)) / ideal ELSE 0 END), 6) AS ndcg,
round(sum(CASE WHEN (y > 0) = (z > 0) THEN 0.0 WHEN z > 0 THEN abs((h + 1) / k::DOUBLE - (h + 1) / (k + 1)::DOUBLE) / hits ELSE abs(h / (k + 1)::DOUBLE - h / k::DOUBLE) / hits END), 6) AS map
FROM n JOIN g ON g.l_orderkey = n.l_orderkey WHERE z IS NOT NULL GROUP BY 1"""
VOCABULARY = r"w AS (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r]+')) AS word FROM documents), v AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1 HAVING count(*) >= 5)"
CUTS = f"""WITH b AS (SELECT l_quantity AS x, sum(l_tax * 100) AS w FROM lineitem GROUP BY 1 HAVING sum(l_tax * 100) > 0),
r AS (SELECT x, sum(w) OVER (ORDER BY x) - w / 2.0 AS middle, sum(w) OVER () AS t FROM b), k AS (SELECT unnest(range(1, {BINS}))::INTEGER AS k)
SELECT k, arg_min(x, (abs(middle - k * t / {BINS}.0), x))::DOUBLE AS value FROM r, k GROUP BY 1"""
# the weights as they are: a mean of rounded weights is another one
ONE_SPLIT = FIRST_SPLIT.replace("round(a::DOUBLE, 6) AS", "a::DOUBLE AS").replace("round(b::DOUBLE, 6) AS", "b::DOUBLE AS").replace("SELECT feature, x::DOUBLE AS threshold", "SELECT * FROM (SELECT feature, x::DOUBLE AS threshold") + """) s,
LATERAL (SELECT l_orderkey, l_linenumber, CASE WHEN CASE s.feature WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount ELSE l_tax END <= s.threshold THEN s.left_weight ELSE s.right_weight END AS w FROM lineitem)"""
WEIGHTS = "w AS (SELECT query, label, 1 + neighbour % 3 AS w FROM k WHERE place <= 7), v AS (SELECT query, label, sum(w) AS n FROM w GROUP BY ALL)"

QUERIES = {
    "knn_within": (within, f"WITH {NEAR} SELECT q.vec_id AS query, count(k.query)::INTEGER AS n, round(coalesce(sum(distance), 0.0), 5) AS total FROM embeddings q LEFT JOIN k ON k.query = q.vec_id AND place <= 10 AND distance <= {WITHIN} WHERE q.vec_id % 50 = 0 GROUP BY 1"),
    "knn_weighted": (weighted, f"WITH {NEAR}, {WEIGHTS}, p1 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, label) AS r, sum(n) OVER (PARTITION BY query) AS t FROM v) SELECT p1.query, p1.label, round(n / t, 6) AS share, round(m.value, 6) AS value FROM p1 JOIN (SELECT query, sum(w * label) / sum(w) AS value FROM w GROUP BY 1) m ON m.query = p1.query WHERE r = 1"),
    "stats_with_nulls": (holed, _holed_sql()),
    "sketch_weighted_cuts": (weighted_cuts, CUTS),
    "sketch_weighted_ranks": (weighted_ranks, "SELECT unnest(range(1, 100))::INTEGER AS k, true AS near"),
    "rank_swaps": (swaps, SWAPS),
    "graph_pagerank_update": (updated, GRAPHS["graph_pagerank_converged"][1].replace("0.15", "0.6").replace("0.85", "0.4")),
    "graph_weighted_closeness": (weighted_closeness, _weighted_closeness_sql()),
    "text_vocabulary": (vocabulary, f"WITH {VOCABULARY} SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS place FROM v"),
    "text_word_codes": (word_codes, f"WITH {VOCABULARY} SELECT count(*) AS words, 1.0::DOUBLE AS filled, 0::BIGINT AS shorter FROM v"),
    "text_word_means": (word_means, rf"WITH {VOCABULARY}, d AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r]+')) AS word FROM documents) SELECT doc_id, 12::INTEGER AS size, bool_or(word IN (SELECT word FROM v)) AS known FROM d GROUP BY 1"),
    "cluster_parallel": (parallel, "SELECT count(*) AS points, 12::BIGINT AS clusters, true AS near FROM embeddings"),
    "matrix_word_vectors": (word_vectors, r"SELECT unnest(range(4))::INTEGER AS component, (SELECT count(DISTINCT w) FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r]+')) AS w FROM documents) WHERE w <> '') AS columns, 0.0::DOUBLE AS gap, 1.0::DOUBLE AS length"),
    "matrix_largest_value": (largest_value, _largest_sql()),
    "matrix_similar_columns": (similar, "WITH b AS (SELECT o_custkey AS u, l_partkey AS i, count(*)::DOUBLE AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), m AS (SELECT i, sqrt(sum(n * n)) AS m FROM b GROUP BY 1), p AS (SELECT x.i AS a, y.i AS b, sum(x.n * y.n) AS d FROM b x JOIN b y ON x.u = y.u AND x.i < y.i GROUP BY ALL) SELECT p.a AS part_a, p.b AS part_b, round(d / (x.m * y.m), 6) AS similarity FROM p JOIN m x ON x.i = p.a JOIN m y ON y.i = p.b WHERE d / (x.m * y.m) >= 0.4"),
    "boost_shapley": (shapley, "SELECT l_orderkey, l_linenumber, 0.0::DOUBLE AS gap, 0.0::DOUBLE AS pair_gap FROM lineitem"),
    "boost_shapley_split": (shapley_of_a_split, f"WITH w AS ({ONE_SPLIT}), m AS (SELECT avg(w) AS m FROM w) SELECT l_orderkey, l_linenumber, round(w - m, 6) AS value, round(m, 6) AS mean FROM w, m"),
}
