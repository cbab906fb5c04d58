"""Registered queries of trees, forests, survival, curves, factors and weighted communities: name, (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import curves, losses
from tessera.operators import boosting as B
from tessera.operators import factors as A
from tessera.operators import forest as R
from tessera.operators import graph as G
from tessera.plans import tables as T

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linestatus"]


def _root(model: R.Forest, spark) -> DataFrame:
    """The root's split: feature, categories that go left, gain and how many rows go left."""
    table = model.table(spark)
    left = table.filter("node = 1").select(F.col("weight").cast("long").alias("left_n"))
    return table.filter("node = 0").select("feature", F.array_join("categories", ",").alias("left_side"), F.round("gain", 7).alias("gain")).join(left)


def subset_split(spark, d):
    """The best set of priorities to tell the three order states apart, of all sets."""
    orders = T.load(spark, d, "orders")
    return _root(R.grow(orders, ["o_orderpriority"], "o_orderstatus", "o_orderkey", R.Params(depth=1, **R.SINGLE), ("o_orderpriority",)), spark)


SUBSET_SPLIT = """WITH k AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS k FROM orders GROUP BY 1),
c AS (SELECT o_orderpriority AS v, o_orderstatus AS y, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
m AS (SELECT unnest(range(1, (1 << ((SELECT count(*) FROM k) - 1)::INTEGER)::BIGINT)) AS mask),
s AS (SELECT mask, y, coalesce(sum(n) FILTER ((mask >> k.k) & 1 = 1), 0) AS l, coalesce(sum(n) FILTER ((mask >> k.k) & 1 = 0), 0) AS r FROM m, c JOIN k USING (v) GROUP BY 1, 2),
g AS (SELECT mask, sum(l) AS ln, (sum(l * l) / sum(l) + sum(r * r) / sum(r) - sum((l + r) * (l + r)) / sum(l + r)) / sum(l + r) AS gain FROM s GROUP BY 1),
b AS (SELECT * FROM g ORDER BY gain DESC, mask LIMIT 1)
SELECT 'o_orderpriority' AS feature, (SELECT string_agg(v, ',' ORDER BY v) FROM k WHERE (b.mask >> k.k) & 1 = 1) AS left_side, round(gain, 7) AS gain, ln::BIGINT AS left_n FROM b"""


def variance_split(spark, d):
    """The best set of market segments to tell high balances from low ones."""
    customers = T.load(spark, d, "customer")
    root = _root(R.grow(customers, ["c_mktsegment"], "c_acctbal", "c_custkey", R.Params(depth=1, impurity="variance", **R.SINGLE), ("c_mktsegment",)), spark)
    return root.withColumn("gain", F.round("gain", 3))


VARIANCE_SPLIT = """WITH k AS (SELECT c_mktsegment AS v, count(*)::DOUBLE AS n, sum(c_acctbal) AS y, avg(c_acctbal) AS a FROM customer GROUP BY 1),
s AS (SELECT a, sum(n) OVER w AS ln, sum(y) OVER w AS ly, sum(n) OVER () AS tn, sum(y) OVER () AS ty FROM k WINDOW w AS (ORDER BY a)),
b AS (SELECT *, (ly * ly / ln + (ty - ly) * (ty - ly) / (tn - ln) - ty * ty / tn) / tn AS gain FROM s WHERE ln < tn ORDER BY gain DESC LIMIT 1)
SELECT 'c_mktsegment' AS feature, (SELECT string_agg(v, ',' ORDER BY v) FROM k WHERE k.a <= b.a) AS left_side, round(gain, 3) AS gain, ln::BIGINT AS left_n FROM b"""


def entropy_split(spark, d):
    """The best cut of the discount by entropy for three return flags, with the shares of the flags on both sides."""
    lines = T.load(spark, d, "lineitem")
    model = R.grow(lines, ["l_discount"], "l_returnflag", "l_orderkey", R.Params(depth=1, impurity="entropy", **R.SINGLE))
    table = model.table(spark)
    root = table.filter("node = 0").select(F.round("threshold", 6).alias("threshold"), F.round("gain", 9).alias("gain"))
    sides = table.filter("node > 0").select("node", F.posexplode("value").alias("k", "share"))
    named = sides.select("node", F.element_at(F.array(*map(F.lit, model.classes)), F.col("k") + 1).alias("flag"), F.round("share", 7).alias("share"))
    return named.join(root)


ENTROPY_SPLIT = """WITH c AS (SELECT l_discount AS x, l_returnflag AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
grid AS (SELECT x, y FROM (SELECT DISTINCT x FROM c), (SELECT DISTINCT y FROM c)),
s AS (SELECT x, y, sum(coalesce(n, 0)) OVER (PARTITION BY y ORDER BY x) AS l, sum(coalesce(n, 0)) OVER (PARTITION BY y) AS t FROM grid LEFT JOIN c USING (x, y)),
e AS (SELECT *, sum(l) OVER (PARTITION BY x) AS ln, sum(t) OVER (PARTITION BY x) AS tn FROM s),
g AS (SELECT x, (sum(CASE WHEN l > 0 THEN l * log2(l / ln) ELSE 0 END) + sum(CASE WHEN t > l THEN (t - l) * log2((t - l) / (tn - ln)) ELSE 0 END) - sum(t * log2(t / tn))) / any_value(tn) AS gain FROM e WHERE ln < tn GROUP BY 1 ORDER BY gain DESC, x LIMIT 1)
SELECT node, y AS flag, round(CASE node WHEN 1 THEN l / ln ELSE (t - l) / (tn - ln) END, 7) AS share, round(x, 6) AS threshold, round(gain, 9) AS gain FROM g JOIN e USING (x), (VALUES (1), (2)) v(node)"""


def classify(spark, d):
    """Shares of the three return flags by a forest of bags over numbers and a category, for every line."""
    lines = T.load(spark, d, "lineitem").withColumn("line", F.struct("l_orderkey", "l_linenumber"))
    model = R.grow(lines, FEATURES, "l_returnflag", "line", R.Params(trees=10, depth=4), ("l_linestatus",))
    said = model.predict(lines.select("l_orderkey", "l_linenumber", *FEATURES))
    return said.select("l_orderkey", "l_linenumber", "prediction", *(F.round(F.col("shares")[k], 6).alias(f"share_{c.lower()}") for k, c in enumerate(model.classes)))


def _first_split(model: B.Model, spark) -> DataFrame:
    t = model.table(spark).filter("node = 0").select("feature", "threshold", F.round("gain", 5).alias("gain"))
    leaves = model.table(spark).filter("node > 0").groupBy().pivot("node", [1, 2]).agg(F.round(F.first("weight"), 6)).toDF("left_weight", "right_weight")
    return t.join(leaves)


def _waits(spark, d) -> DataFrame:
    """Lines with a time (the quantity, a 25th of it), which is censored where there is no discount, and its bounds."""
    censored = F.col("l_discount") <= 0.02
    t = F.col("l_quantity") / 25
    return T.load(spark, d, "lineitem").select("l_tax", "l_extendedprice", t.alias("low"), F.when(~censored, t).alias("high"), F.when(censored, -t).otherwise(t).alias("signed"), F.dayofmonth("l_shipdate").cast("double").alias("day"))


def aft_split(spark, d):
    """The first split of trees for an accelerated failure time with logistic noise."""
    return _first_split(B.boost(_waits(spark, d), ["l_tax", "day"], "low", B.Params(objective="aft", noise="logistic", rounds=1, depth=1), upper="high"), spark)


def cox_split(spark, d):
    """The first split of trees for proportional hazards."""
    return _first_split(B.boost(_waits(spark, d), ["l_tax", "day"], "signed", B.Params(objective="cox", rounds=1, depth=1)), spark)


_WAITS = "w AS MATERIALIZED (SELECT l_tax, day(l_shipdate)::DOUBLE AS day, l_quantity / 25 AS t, l_discount <= 0.02 AS c FROM lineitem)"


def _split_sql(made: str) -> str:
    """The first split by gradients ``g`` and hessians ``h`` of the table ``p``."""
    return f"""WITH {_WAITS}, {made},
f AS (SELECT 1 AS k, 'l_tax' AS feature, l_tax AS x, g, h FROM p UNION ALL SELECT 2, 'day', day, g, h FROM p),
s AS (SELECT k, feature, x, sum(sum(g)) OVER o AS g1, sum(sum(h)) OVER o AS h1, sum(sum(g)) OVER (PARTITION BY k) AS g0, sum(sum(h)) OVER (PARTITION BY k) AS h0, max(x) OVER (PARTITION BY k) AS most FROM f GROUP BY k, feature, x WINDOW o AS (PARTITION BY k ORDER BY x)),
b AS (SELECT k, feature, x, g1 * g1 / (h1 + 1) + (g0 - g1) * (g0 - g1) / (h0 - h1 + 1) - g0 * g0 / (h0 + 1) AS gain, -0.3 * g1 / (h1 + 1) AS l, -0.3 * (g0 - g1) / (h0 - h1 + 1) AS r FROM s WHERE x < most)
SELECT feature, x::DOUBLE AS threshold, round(gain, 5) AS gain, round(l, 6) AS left_weight, round(r, 6) AS right_weight FROM b ORDER BY b.gain DESC, k, x LIMIT 1"""


AFT_SPLIT = _split_sql("p AS (SELECT l_tax, day, CASE WHEN c THEN -t / (1 + t) ELSE (1 - t) / (1 + t) END AS g, CASE WHEN c THEN 1 ELSE 2 END * t / ((1 + t) * (1 + t)) AS h FROM w)")
COX_SPLIT = _split_sql("""n AS (SELECT t, count(*)::DOUBLE AS n, count(*) FILTER (NOT c) AS e FROM w GROUP BY 1), r AS (SELECT t, e, sum(n) OVER (ORDER BY t DESC) AS risk FROM n),
a AS (SELECT t, sum(e / risk) OVER (ORDER BY t) AS r1, sum(e / (risk * risk)) OVER (ORDER BY t) AS r2 FROM r), p AS (SELECT l_tax, day, r1 - CASE WHEN c THEN 0 ELSE 1 END AS g, r1 - r2 AS h FROM w JOIN a USING (t))""")


def _weighed(spark, d) -> DataFrame:
    q = F.when(F.col("l_tax") > 0, F.col("l_quantity") / 50)
    return T.flagged(spark, d).select("l_linenumber", "y", q.alias("q"), (F.col("l_discount") * 10 + 1).alias("w"))


WEIGHED = "WITH r AS MATERIALIZED (SELECT l_linenumber AS g, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity / 50 AS q, l_discount * 10 + 1 AS w FROM lineitem WHERE l_tax > 0)"


def areas(spark, d):
    """Areas under both curves by line number and weight; untaxed lines have no score."""
    return curves.areas(_weighed(spark, d), "q", "y", "w", "l_linenumber").select("group", F.round("auc", 8).alias("auc"), F.round("aucpr", 8).alias("aucpr"))


AREAS = WEIGHED + """, b AS (SELECT g, q, coalesce(sum(w) FILTER (y = 1), 0) AS pos, coalesce(sum(w) FILTER (y = 0), 0) AS neg FROM r GROUP BY 1, 2),
c AS (SELECT g, pos, neg, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp FROM b WINDOW o AS (PARTITION BY g ORDER BY q DESC))
SELECT g AS "group", CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(1 - sum(pos * (fp - neg / 2)) / (sum(pos) * sum(neg)), 8) END AS auc, CASE WHEN sum(pos) > 0 THEN round(sum(pos * tp / (tp + fp)) / sum(pos), 8) END AS aucpr FROM c GROUP BY 1"""


def significance(spark, d):
    """Significance of the best tenth and of the best cut, error at two thresholds, deviance at two variance powers."""
    rows = _weighed(spark, d)
    some = curves.ams(rows, "q", "y", 0.1, "w").select(F.round("ams", 6).alias("ams_tenth"))
    best = curves.ams(rows, "q", "y", 1.0, "w").select(F.round("ams", 6).alias("ams_best"))
    names = ["error@0.3", "error@0.8", "tweedie_nloglik@1.2", "tweedie_nloglik@1.5"]
    rest = losses.evaluate(rows.filter("q is not null"), "q", "y", names, "w")
    return some.join(best).join(rest.select(*(F.round(F.col(f"`{n}`"), 6).alias(a) for n, a in zip(names, ("error_30", "error_80", "tweedie_12", "tweedie_15"), strict=True))))


SIGNIFICANCE = WEIGHED + """, b AS (SELECT q, count(*) AS n, coalesce(sum(w) FILTER (y = 1), 0) AS s, coalesce(sum(w) FILTER (y = 0), 0) AS b FROM r GROUP BY 1),
c AS (SELECT *, sum(n) OVER o AS nu, sum(s) OVER o AS su, sum(b) OVER o AS bu, sum(n) OVER () AS t FROM b WINDOW o AS (ORDER BY q DESC)),
e AS (SELECT max(sqrt(2 * ((su + bu + 10) * ln(1 + su / (bu + 10)) - su))) FILTER (nu < t) AS best, sum(s * x) AS s, sum(b * x) AS b FROM (SELECT *, greatest(0, least(1, (floor(0.1 * t) - nu + n) / n))::DOUBLE AS x FROM c))
SELECT round(sqrt(2 * ((s + b + 10) * ln(1 + s / (b + 10)) - s)), 6) AS ams_tenth, round(best, 6) AS ams_best, m.* FROM e,
(SELECT round(sum(w * CASE WHEN q > 0.3 THEN 1 - y ELSE y END) / sum(w), 6) AS error_30, round(sum(w * CASE WHEN q > 0.8 THEN 1 - y ELSE y END) / sum(w), 6) AS error_80,
round(sum(w * (power(q, 0.8) / 0.8 + y * power(q, -0.2) / 0.2)) / sum(w), 6) AS tweedie_12, round(sum(w * (power(q, 0.5) / 0.5 + y * power(q, -0.5) / 0.5)) / sum(w), 6) AS tweedie_15 FROM r) m"""


def products(spark, d):
    """For every fiftieth vector the ten of all with the largest product."""
    p = T.points(spark, d).select("id", "vec")
    return A.recommend(p.filter("id % 50 = 0"), p, 10).select("query", "candidate", F.round("score", 6).alias("score"), "place")


PRODUCTS = """WITH p AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.id AS query, b.id AS candidate, list_dot_product(a.v, b.v) AS score FROM p a, p b WHERE a.id % 50 = 0)
SELECT query, candidate, round(score, 6) AS score, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS place FROM s) WHERE place <= 10"""


def scores(spark, d):
    """Scores of each supplier's parts by the vectors of their numbers: how many are unknown, and the sum of the others."""
    # as they are stored: products are of doubles all the same
    p = T.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    pairs = T.load(spark, d, "lineitem").select(F.col("l_suppkey").alias("user"), F.col("l_partkey").alias("item"))
    said = F.col("prediction")
    return A.predict(pairs, p, p).groupBy("user").agg(F.sum(F.isnan(said).cast("long")).alias("unknown"), F.round(F.sum(F.when(~F.isnan(said), said)), 4).alias("total"))


SCORES = """WITH p AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT l_suppkey AS "user", count(*) FILTER (a.id IS NULL OR b.id IS NULL)::BIGINT AS unknown, round(sum(list_dot_product(a.v, b.v)), 4) AS total FROM lineitem LEFT JOIN p a ON a.id = l_suppkey LEFT JOIN p b ON b.id = l_partkey GROUP BY 1"""


def weighted_modularity(spark, d):
    """How well suppliers by their number modulo five explain the flow between them, by amount, with and without direction."""
    e = T.supply_graph(spark, d)
    c = G.vertices(e).withColumn("community", F.col("id") % 5)
    flows = G.modularity(e, c, "amount", True).select(F.round("modularity", 9).alias("directed"))
    return flows.join(G.modularity(e, c, "amount").select(F.round("modularity", 9).alias("undirected")))


WEIGHTED_MODULARITY = f"""WITH {T.SUPPLIES}, v AS (SELECT src % 5 AS c, sum(amount) AS o, 0 AS i FROM edges GROUP BY 1 UNION ALL SELECT dst % 5, 0, sum(amount) FROM edges GROUP BY 1),
k AS (SELECT c, sum(o) AS o, sum(i) AS i FROM v GROUP BY 1), n AS (SELECT src % 5 AS c, sum(amount) AS n FROM edges WHERE src % 5 = dst % 5 GROUP BY 1), m AS (SELECT sum(amount) AS m FROM edges)
SELECT round(sum(coalesce(n, 0) / m - o * i / (m * m)), 9) AS directed, round(sum(coalesce(n, 0) / m - power((o + i) / (2 * m), 2)), 9) AS undirected FROM k LEFT JOIN n USING (c), m"""


QUERIES = {
    "forest_subset_split": (subset_split, SUBSET_SPLIT),
    "forest_variance_split": (variance_split, VARIANCE_SPLIT),
    "forest_entropy_split": (entropy_split, ENTROPY_SPLIT),
    "forest_classify": (classify, None),
    "metric_areas": (areas, AREAS),
    "metric_significance": (significance, SIGNIFICANCE),
    "recommend_products": (products, PRODUCTS),
    "recommend_scores": (scores, SCORES),
    "graph_modularity_weighted": (weighted_modularity, WEIGHTED_MODULARITY),
    "boost_aft_split": (aft_split, AFT_SPLIT),
    "boost_cox_split": (cox_split, COX_SPLIT),
}
