"""Registered queries of communities, cliques, walks, survival and multi-class losses, boosters: name, (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import losses as L
from tessera.functions import survival as V
from tessera.functions.storage import cut
from tessera.operators import boosting as B
from tessera.operators import communities as C
from tessera.operators import graph as G
from tessera.plans import tables as T
from tessera.plans.graph_queries import DIRECTED, _pagerank_sql

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def louvain(spark, d):
    return C.louvain(T.together(spark, d))


def cliques(spark, d):
    return C.maximal_cliques(T.together(spark, d)).select("size", F.array_join("members", ",").alias("members"))


def walks(spark, d):
    return C.biased_walks(T.together(spark, d), 5, 2, back=2.0, out=0.5).select("walk", "id", F.array_join("path", ",").alias("path"))


def vectors(spark, d):
    found = C.node_vectors(C.biased_walks(T.together(spark, d), 5, 2))
    return found.select("id", F.transform("vector", lambda x: F.round(x, 5)).alias("vector"))


def breadth(spark, d):
    return C.breadth_first(T.supply_graph(spark, d), 1).select("id", F.array_join("path", ",").alias("path"), "distance")


def clustering_totals(spark, d):
    found = G.clustering(T.together(spark, d))
    wedges = F.col("degree") * (F.col("degree") - 1) / 2
    return found.agg(F.round(F.avg("coefficient"), 9).alias("average"), F.round(F.sum("triangles") / F.sum(wedges), 9).alias("overall"))


def warm_start(spark, d):
    e = T.purchase_graph(spark, d, cut(T.bought(spark, d).select("user", "item", "n")))
    old = G.pagerank(e.filter("weight = 1"), 5)
    return G.pagerank(e, 5, start=old).select("id", F.round("rank", 6).alias("rank"))


def _times(spark, d):
    """Lines as lives: the time is the price, its sign tells returned (an event) from not; the margin is the discount."""
    rows = T.flagged(spark, d)
    return rows.withColumns({"t": F.when(F.col("y") == 1, F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice")), "m": F.col("l_discount") * 5})


def cox(spark, d):
    return V.cox_gradients(_times(spark, d), "m", "t").select("l_orderkey", "l_linenumber", F.round("gradient", 5).alias("gradient"), F.round("hessian", 5).alias("hessian"))


def cox_metric(spark, d):
    return V.cox_nloglik(_times(spark, d), "m", "t").select(F.round("cox_nloglik", 5).alias("cox_nloglik"))


def aft_metric(spark, d):
    rows = T.flagged(spark, d).withColumns({"low": F.col("l_quantity"), "high": F.when(F.col("y") == 1, F.col("l_quantity")), "m": F.col("l_discount") + 3})
    return V.aft_nloglik(rows, "m", "low", "high").select(F.round("aft_nloglik", 5).alias("aft_nloglik"))


def class_metrics(spark, d):
    shares = V.softmax([F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(0.5)])
    rows = _classes(spark, d).withColumns({f"p{k}": s for k, s in enumerate(shares)})
    return V.multiclass(rows, ["p0", "p1", "p2"], "c").select(F.round("merror", 6).alias("merror"), F.round("mlogloss", 6).alias("mlogloss"))


def precision_recall(spark, d):
    rows = T.flagged(spark, d).withColumn("q", F.col("l_quantity") / 50.0)
    return V.average_precision(rows, "q", "y").select(F.round("aucpr", 7).alias("aucpr"))


def count_metrics(spark, d):
    rows = T.flagged(spark, d).withColumn("q", F.col("l_discount") + 1)
    return L.evaluate(rows, "q", "y", ["poisson_nloglik"]).select(F.round("poisson_nloglik", 6).alias("poisson_nloglik"))


def _classes(spark, d):
    flag = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return T.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *NUMERIC, flag.alias("c"))


def boosted_classes(spark, d):
    rows = _classes(spark, d)
    models = B.boost_classes(rows, NUMERIC, "c", 3, B.Params(rounds=2, depth=2))
    for k, m in enumerate(models):
        rows = m.transform(rows, margin=f"m{k}")
    return rows.select("l_orderkey", "l_linenumber", *(F.round(p, 6).alias(f"p{k}") for k, p in enumerate(V.softmax([F.col(f"m{k}") for k in range(3)]))))


def boosted_dropping(spark, d):
    rows = T.flagged(spark, d)
    model = B.boost_dropping(rows, NUMERIC, "y", B.Params(objective="logistic", rounds=4, depth=2), rate=0.4)
    return model.transform(rows).select("l_orderkey", "l_linenumber", F.round(L.sigmoid(F.col("margin")), 6).alias("p"))


def boosted_linear(spark, d):
    rows = T.flagged(spark, d).withColumn("price", F.col("l_extendedprice") / 10000)
    weights = B.boost_linear(rows, ["l_quantity", "l_discount"], "price", B.Params(rounds=2, eta=0.5))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.lit(weights["bias"]) + sum((F.col(f) * w for f, w in weights.items() if f != "bias"), F.lit(0.0)), 5).alias("margin"))


def contributions(spark, d):
    rows = T.flagged(spark, d)
    model = B.boost(rows, NUMERIC, "y", B.Params(objective="logistic", rounds=2, depth=3))
    return model.contributions(rows).select("l_orderkey", "l_linenumber", *(F.round(F.col("contributions")[k], 6).alias(n) for k, n in enumerate([*NUMERIC, "rest"])))


CLIQUES = f"""WITH {T.TOGETHER}, t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM pairs x JOIN pairs y ON x.dst = y.src JOIN pairs z ON z.src = x.src AND z.dst = y.dst),
q AS (SELECT t.a, t.b, t.c, u.dst AS e FROM t JOIN pairs u ON u.src = t.a JOIN pairs v ON v.src = t.b AND v.dst = u.dst JOIN pairs w ON w.src = t.c AND w.dst = u.dst),
five AS (SELECT q.*, u.dst AS f FROM q JOIN pairs u ON u.src = q.a JOIN pairs v ON v.src = q.b AND v.dst = u.dst JOIN pairs w ON w.src = q.c AND w.dst = u.dst JOIN pairs x ON x.src = q.e AND x.dst = u.dst),
in4 AS (SELECT a, b, c FROM q UNION SELECT a, b, e FROM q UNION SELECT a, c, e FROM q UNION SELECT b, c, e FROM q),
in5 AS (SELECT a, b, c, e FROM five UNION SELECT a, b, c, f FROM five UNION SELECT a, b, e, f FROM five UNION SELECT a, c, e, f FROM five UNION SELECT b, c, e, f FROM five)
SELECT 3 AS size, concat_ws(',', a, b, c) AS members FROM (SELECT * FROM t EXCEPT SELECT * FROM in4) UNION ALL SELECT 4, concat_ws(',', a, b, c, e) FROM (SELECT * FROM q EXCEPT SELECT * FROM in5) UNION ALL SELECT 5, concat_ws(',', a, b, c, e, f) FROM five"""
BREADTH = DIRECTED + """, parent AS (SELECT s.dst AS id, min(s.src) AS parent FROM step s JOIN best a ON a.id = s.src AND a.source = 1 JOIN best b ON b.id = s.dst AND b.source = 1 AND b.distance = a.distance + 1 GROUP BY 1),
tree AS (SELECT id, id::VARCHAR AS path, 0 AS distance FROM best WHERE source = 1 AND distance = 0 UNION ALL SELECT p.id, t.path || ',' || p.id, t.distance + 1 FROM tree t JOIN parent p ON p.parent = t.id) SELECT id, path, distance FROM tree"""
BREADTH = BREADTH.replace("WITH ", "WITH RECURSIVE ", 1)


def _warm_sql() -> str:
    """Five rounds on the edges of weight 1, then five on all edges from the ranks found."""
    cold = _pagerank_sql(5).replace("edges AS (", "every AS (").replace("nodes AS (SELECT DISTINCT src AS id FROM edges)", "edges AS (SELECT * FROM every WHERE weight = 1), nodes AS (SELECT DISTINCT src AS id FROM edges)")
    cold = cold.replace("SELECT id, round(r, 6) AS rank FROM r5", "")
    made = ["whole AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS s FROM every)", "w0 AS MATERIALIZED (SELECT id, coalesce(r, 1.0) AS r FROM (SELECT DISTINCT src AS id FROM every) LEFT JOIN r5 USING (id))"]
    for k in range(1, 6):
        made.append(f"w{k} AS MATERIALIZED (SELECT id, 0.15 + 0.85 * coalesce(g, 0) AS r FROM w0 LEFT JOIN (SELECT dst, sum(s * r) AS g FROM whole JOIN w{k - 1} ON src = id GROUP BY dst) ON id = dst)")
    return f"{cold}, {', '.join(made)} SELECT id, round(r, 6) AS rank FROM w5"


def _linear_sql() -> str:
    """Two rounds of coordinate steps over bias, l_quantity, l_discount: eta 0.5, lambda 1 but for the bias."""
    made, m = ["p AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS x1, l_discount::DOUBLE AS x2, l_extendedprice / 10000 AS y FROM lineitem)", "t0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2)"], 0
    for _ in range(2):
        for k, x in enumerate(("1.0", "x1", "x2")):
            m += 1
            ridge = "0.0" if k == 0 else "1.0"
            new = f"w{k} + 0.5 * ((w{k} * (h + {ridge}) - (g + {ridge} * w{k})) / (h + {ridge}) - w{k}) AS w{k}"
            rest = ", ".join(new if j == k else f"w{j}" for j in range(3))
            made.append(f"t{m} AS MATERIALIZED (SELECT {rest} FROM (SELECT w0, w1, w2, sum((w0 + w1 * x1 + w2 * x2 - y) * {x}) AS g, sum({x} * {x})::DOUBLE AS h FROM p, t{m - 1} GROUP BY 1, 2, 3))")
    return f"WITH {', '.join(made)} SELECT l_orderkey, l_linenumber, round(w0 + w1 * x1 + w2 * x2, 5) AS margin FROM p, t{m}"


TOTALS = f"""WITH {T.TOGETHER}, t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM pairs x JOIN pairs y ON x.dst = y.src JOIN pairs z ON z.src = x.src AND z.dst = y.dst), e AS (SELECT unnest([a, b, c]) AS id FROM t), n AS (SELECT deg.id, degree, count(e.id) AS t FROM deg LEFT JOIN e ON e.id = deg.id GROUP BY 1, 2)
SELECT round(avg(CASE WHEN degree > 1 THEN 2.0::DOUBLE * t / (degree * (degree - 1)) ELSE 0 END), 9) AS average, round(sum(t)::DOUBLE / sum(degree * (degree - 1) / 2)::DOUBLE, 9) AS overall FROM n"""
LIVES = """p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS time, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS event, l_discount * 5 AS m FROM lineitem),
b AS (SELECT time, sum(exp(m)) AS e, sum(event) AS n FROM p GROUP BY 1), r AS (SELECT time, n, sum(e) OVER (ORDER BY time DESC) AS risk FROM b),
s AS (SELECT time, risk, sum(n / risk) OVER (ORDER BY time) AS r1, sum(n / (risk * risk)) OVER (ORDER BY time) AS s1 FROM r)"""
CLASSED = """c AS (SELECT CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS c, exp(l_discount * 10) AS a, exp(l_tax * 10) AS b, exp(0.5::DOUBLE) AS d FROM lineitem)"""

QUERIES = {
    "graph_louvain": (louvain, None),
    "graph_cliques": (cliques, CLIQUES),
    "graph_walks": (walks, None),
    "graph_node_vectors": (vectors, None),
    "graph_breadth_first": (breadth, BREADTH),
    "graph_clustering_totals": (clustering_totals, TOTALS),
    "graph_pagerank_warm_start": (warm_start, _warm_sql()),
    "boost_cox": (cox, f"WITH {LIVES} SELECT l_orderkey, l_linenumber, round(exp(m) * r1 - event, 5) AS gradient, round(exp(m) * r1 - exp(2 * m) * s1, 5) AS hessian FROM p JOIN s USING (time)"),
    "metric_cox": (cox_metric, f"WITH {LIVES} SELECT round(avg(ln(risk) - m), 5) AS cox_nloglik FROM p JOIN s USING (time) WHERE event = 1"),
    "metric_aft": (aft_metric, "WITH p AS (SELECT l_quantity AS q, l_returnflag = 'R' AS event, 1 / (1 + exp(l_discount + 3 - ln(l_quantity))) AS c FROM lineitem) SELECT round(avg(-ln(CASE WHEN event THEN c * (1 - c) / q ELSE 1 - c END)), 5) AS aft_nloglik FROM p"),
    "metric_multiclass": (class_metrics, f"WITH {CLASSED} SELECT round(avg(CASE WHEN (CASE WHEN a >= b AND a >= d THEN 1 WHEN b >= d THEN 2 ELSE 3 END) = c THEN 0.0 ELSE 1.0 END)::DOUBLE, 6) AS merror, round(avg(-ln((CASE c WHEN 1 THEN a WHEN 2 THEN b ELSE d END) / (a + b + d))), 6) AS mlogloss FROM c"),
    "metric_aucpr": (precision_recall, "WITH b AS (SELECT l_quantity AS q, count(*) FILTER (l_returnflag = 'R') AS pos, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT pos, sum(pos) OVER (ORDER BY q DESC) AS tp, sum(n) OVER (ORDER BY q DESC) AS seen FROM b) SELECT round((sum(pos * (tp / seen)) / sum(pos))::DOUBLE, 7) AS aucpr FROM r"),
    "metric_poisson": (count_metrics, "SELECT round(avg(l_discount + 1 - (CASE WHEN l_returnflag = 'R' THEN ln(l_discount + 1) ELSE 0 END)), 6) AS poisson_nloglik FROM lineitem"),
    "boost_classes": (boosted_classes, None),
    "boost_dropping": (boosted_dropping, None),
    "boost_linear": (boosted_linear, _linear_sql()),
    "boost_contributions": (contributions, None),
}
