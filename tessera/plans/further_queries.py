"""Registered queries of matrices, text weights, neighbours' votes, buckets and ranks by source: name, (query, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import learning as M
from tessera.operators import neighbours as N
from tessera.operators import matrices as X
from tessera.operators import stats as S
from tessera.plans import tables as T
from tessera.plans.learning_queries import NEAR, WORDS
from tessera.sources.edges import adjacency

THREE = ["l_quantity", "l_discount", "l_tax"]


def singular_moments(spark, d):
    s, _ = X.singular_values(T.load(spark, d, "lineitem"), THREE, 3)
    return spark.createDataFrame([(k, float((s**k).sum())) for k in (2, 4)], "power int, value double").withColumn("value", F.round(F.log("value"), 8))


def left_products(spark, d):
    rows = T.load(spark, d, "lineitem")
    s, v = X.singular_values(rows, THREE, 3)
    return S.gram(X.left_vectors(rows, THREE, s, v, ["u0", "u1", "u2"]), ["u0", "u1", "u2"]).withColumn("value", F.abs(F.round("value", 6)))


def qr(spark, d):
    r, _ = X.tall_qr(T.load(spark, d, "lineitem"), THREE)
    return spark.createDataFrame([(i, j, float(r[i, j])) for i in range(3) for j in range(i, 3)], "i int, j int, value double").withColumn("value", F.round("value", 5))


def gram_times(spark, d):
    return X.gram_times(T.load(spark, d, "lineitem"), THREE, [1.0, -2.0, 3.0]).withColumn("value", F.round("value", 3))


def tf_idf(spark, d):
    return S.tf_idf(T.load(spark, d, "documents"), 2).withColumn("tf_idf", F.round("tf_idf", 6))


def neighbour_value(spark, d):
    p = T.points(spark, d)
    return M.neighbour_values(N.nearest(p, p.filter("id % 50 = 0"), 5), p.select("id", F.col("label").cast("double").alias("y")), "y").withColumn("value", F.round("value", 6))


def buckets(spark, d):
    rows, trees = M.bucketize(T.flagged(spark, d), ["l_discount", "l_tax"], "y", depth=1)
    return rows.select("l_orderkey", "l_linenumber", F.col("buckets")[0].alias("of_discount"), F.col("buckets")[1].alias("of_tax"))


def by_source(spark, d):
    e = T.supply_graph(spark, d)
    return G.personalised_pagerank(e, G.vertices(e), 4).withColumn("rank", F.round("rank", 7))


def of_adjacency(spark, d):
    lists = adjacency(T.supply_graph(spark, d).select("src", "dst").distinct())
    return G.pagerank_of_adjacency(lists, 5).withColumn("rank", F.round("rank", 6))


GRAMS = "g AS (SELECT " + ", ".join(f"sum({a} * {b})::DOUBLE AS g{i}{j}" for i, a in enumerate(THREE) for j, b in enumerate(THREE)) + " FROM lineitem)"
CHOLESKY = f"""WITH {GRAMS}, a AS (SELECT *, sqrt(g00) AS r00, g01 / sqrt(g00) AS r01, g02 / sqrt(g00) AS r02 FROM g), b AS (SELECT *, sqrt(g11 - r01 * r01) AS r11, (g12 - r01 * r02) / sqrt(g11 - r01 * r01) AS r12 FROM a),
c AS (SELECT *, sqrt(g22 - r02 * r02 - r12 * r12) AS r22 FROM b) """ + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(r{i}{j}, 5) AS value FROM c" for i in range(3) for j in range(i, 3))
GINI = """WITH p AS (SELECT l_orderkey, l_linenumber, l_discount, l_tax, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS y FROM lineitem),
f AS (SELECT 1 AS k, l_discount AS x, y FROM p UNION ALL SELECT 2, l_tax, y FROM p),
s AS (SELECT k, x, sum(sum(y)) OVER w AS y1, sum(count(*)) OVER w AS n1, sum(sum(y)) OVER (PARTITION BY k) AS y0, sum(count(*)) OVER (PARTITION BY k) AS n0 FROM f GROUP BY k, x WINDOW w AS (PARTITION BY k ORDER BY x)),
c AS (SELECT k, x FROM (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY round((y1 * (n1 - y1) / n1 + (y0 - y1) * (n0 - n1 - y0 + y1) / (n0 - n1)) / n0, 12), x) AS place FROM s WHERE n1 < n0) WHERE place = 1)
SELECT l_orderkey, l_linenumber, (l_discount > (SELECT x FROM c WHERE k = 1))::INTEGER AS of_discount, (l_tax > (SELECT x FROM c WHERE k = 2))::INTEGER AS of_tax FROM p"""


def _by_source_sql(rounds: int = 4) -> str:
    made = ["share AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS s FROM edges)", "r0 AS MATERIALIZED (SELECT id AS source, id, 1.0::DOUBLE AS r FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges))"]
    for k in range(1, rounds + 1):
        made.append(f"r{k} AS MATERIALIZED (SELECT source, id, sum(r) AS r FROM (SELECT source, source AS id, 0.15::DOUBLE AS r FROM r0 UNION ALL SELECT source, dst, 0.85 * s * r FROM r{k - 1} JOIN share ON src = id) GROUP BY 1, 2)")
    return f"WITH {T.SUPPLIES}, {', '.join(made)} SELECT source, id, round(r, 7) AS rank FROM r{rounds}"


def _adjacency_sql(rounds: int = 5) -> str:
    made = ["share AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS s FROM edges)", "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS r FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges))"]
    for k in range(1, rounds + 1):
        made.append(f"r{k} AS MATERIALIZED (SELECT id, 0.15 + 0.85 * coalesce(g, 0) AS r FROM r0 LEFT JOIN (SELECT dst, sum(s * r) AS g FROM share JOIN r{k - 1} ON src = id GROUP BY dst) ON id = dst)")
    return f"WITH {T.SUPPLIES}, {', '.join(made)} SELECT id, round(r, 6) AS rank FROM r{rounds}"


QUERIES = {
    "stats_singular_moments": (singular_moments, f"WITH {GRAMS} SELECT 2 AS power, round(ln(g00 + g11 + g22), 8) AS value FROM g UNION ALL SELECT 4, round(ln({' + '.join(f'g{i}{j} * g{i}{j}' for i in range(3) for j in range(3))}), 8) FROM g"),
    "stats_left_vectors": (left_products, " UNION ALL ".join(f"SELECT 'u{i}' AS a, 'u{j}' AS b, {float(i == j)}::DOUBLE AS value" for i in range(3) for j in range(i, 3))),
    "stats_qr": (qr, CHOLESKY),
    "stats_gram_vector": (gram_times, " UNION ALL ".join(f"SELECT '{a}' AS name, round(sum({a} * (l_quantity - 2 * l_discount + 3 * l_tax))::DOUBLE, 3) AS value FROM lineitem" for a in THREE)),
    "text_tf_idf": (tf_idf, f"WITH {WORDS.replace('SELECT DISTINCT doc_id', 'SELECT doc_id')}, t AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY 1, 2), f AS (SELECT word, count(DISTINCT doc_id) AS df FROM t GROUP BY 1), m AS (SELECT count(*) AS m FROM documents) SELECT doc_id, word, tf, round(tf * CASE WHEN df >= 2 THEN ln((m + 1)::DOUBLE / (df + 1)) ELSE 0 END, 6) AS tf_idf FROM t JOIN f USING (word), m"),
    "knn_regress": (neighbour_value, f"WITH {NEAR} SELECT query, round(sum(label / (1 + distance)) / sum(1 / (1 + distance)), 6) AS value FROM k WHERE place <= 5 GROUP BY 1"),
    "learn_buckets": (buckets, GINI),
    "graph_personalised_pagerank": (by_source, _by_source_sql()),
    "graph_adjacency_pagerank": (of_adjacency, _adjacency_sql()),
}
