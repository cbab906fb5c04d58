"""Registered statistics, text, neighbour, clustering, learning and boosting queries: name, (query, SQL or None)."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from tessera.functions import losses as L
from tessera.operators import boosting as B
from tessera.operators import learning as M
from tessera.operators import neighbours as N
from tessera.operators import stats as S
from tessera.operators.factors import top_products
from tessera.plans import tables as T
from tessera.plans.graph_queries import _component_sql

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = list(combinations_with_replacement(NUMERIC, 2))


def _rounded(df, column: str = "value", places: int = 6):
    return df.withColumn(column, F.round(column, places))


def _pair_sql(value: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({value.format(a=a, b=b)}, 6) AS value FROM lineitem" for a, b in PAIRS)


def _lines(spark, d):
    return T.load(spark, d, "lineitem")


def covariance(spark, d):
    return _rounded(S.covariance(_lines(spark, d), NUMERIC), places=4)


def gram(spark, d):
    return _rounded(S.gram(_lines(spark, d), NUMERIC), places=0)


def pearson(spark, d):
    return _rounded(S.pearson(_lines(spark, d), NUMERIC))


def spearman(spark, d):
    return _rounded(S.spearman(_lines(spark, d), ["l_quantity", "l_discount"]))


def summary(spark, d):
    return S.summary(_lines(spark, d), NUMERIC).select("name", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), "non_zeros", "least", "most")


def cosine(spark, d):
    return _rounded(S.cosine_columns(_lines(spark, d), NUMERIC))


def regression(spark, d):
    return S.regression(_lines(spark, d), "l_extendedprice", "l_quantity").select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


def components(spark, d):
    share, loadings = S.principal_components(_lines(spark, d), NUMERIC, 3)
    return spark.createDataFrame([(k, s, *map(float, v)) for k, (s, v) in enumerate(zip(share, loadings, strict=True))], "component int, share double, " + ", ".join(f"{c} double" for c in NUMERIC))


def neighbours(spark, d):
    p = T.points(spark, d)
    return N.nearest(p, p.filter("id % 50 = 0"), 5).select("query", "neighbour", F.round("distance", 5).alias("distance"), "place")


def neighbour_class(spark, d):
    p = T.points(spark, d)
    return N.vote(N.nearest(p, p.filter("id % 50 = 0"), 5), p, "label").select("query", "label")


NEAR = """p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
n AS (SELECT q.id AS query, p.id AS neighbour, p.label, list_distance(q.v, p.v) AS distance FROM p q JOIN p ON q.id <> p.id WHERE q.id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS place FROM n)"""


def word_frequency(spark, d):
    return S.document_frequency(T.load(spark, d, "documents"))


def idf(spark, d):
    return S.inverse_document_frequency(T.load(spark, d, "documents"), 2).select("word", F.round("idf", 6).alias("idf"))


WORDS = r"w AS (SELECT DISTINCT doc_id, lang, unnest(regexp_split_to_array(text, '[ \t\n\r]+')) AS word FROM documents)"


def kmeans(spark, d):
    p = T.points(spark, d)
    centres = M.kmeans(p, p.filter("id < 4").select(F.col("id").cast("int").alias("cluster"), "vec"), 3)
    return centres.select("cluster", F.posexplode("vec").alias("i", "x")).select("cluster", "i", F.round("x", 5).alias("x"))


def dbscan(spark, d):
    c = T.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 50.0).alias("vec"))
    return M.dbscan(c, 0.25, 4)


def simrank(spark, d):
    """Of each vertex how many of larger ids are similar to it, and how much in all."""
    return M.simrank(T.bought(spark, d).select("user", "item"), 0.6, 2, True).select("side", "a", "n", F.round("total", 6).alias("total"))


def splits(spark, d):
    return M.impurity_splits(T.flagged(spark, d), "l_quantity", "y").select("threshold", "left_n", F.round("gain", 7).alias("gain"))


SCORED = """p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity, l_quantity / 50.0::DOUBLE AS q, l_extendedprice, l_discount, l_tax FROM lineitem)"""


def _scored(spark, d):
    return T.flagged(spark, d).withColumn("q", F.col("l_quantity") / 50.0)


def metrics(spark, d):
    names = ["rmse", "rmsle", "mae", "error"]
    return L.evaluate(_scored(spark, d), "q", "y", names).select(*(F.round(n, 6).alias(n) for n in names))


def auc(spark, d):
    return L.auc(_scored(spark, d), "q", "y").select(F.round("auc", 9).alias("auc"))


def ranking(spark, d):
    rows = _scored(spark, d).withColumn("row", F.struct("l_linenumber", "l_extendedprice", "l_discount", "l_tax"))
    return L.ranking(rows, "l_orderkey", "q", "y", 3).select("l_orderkey", *(F.round(c, 4).alias(c) for c in ("pre", "ndcg", "map")))


def objectives(spark, d):
    rows = _scored(spark, d)
    made = []
    for name in ("squared_error", "squared_log_error", "logistic", "hinge", "poisson"):
        g, h = L.OBJECTIVES[name](F.col("q"), F.col("y").cast("double"))
        made.append(F.struct(F.lit(name).alias("objective"), F.round(F.sum(g), 3).alias("gradient"), F.round(F.sum(h), 3).alias("hessian")).alias(name))
    return rows.agg(*made).select(F.explode(F.array(*(m for m in ("squared_error", "squared_log_error", "logistic", "hinge", "poisson")))).alias("r")).select("r.*")


def boosted(spark, d):
    rows = T.flagged(spark, d)
    model = B.boost(rows, NUMERIC, "y", B.Params(objective="logistic", rounds=10, depth=6))
    return model.transform(rows, leaves="leaves").select("l_orderkey", "l_linenumber", F.round(L.sigmoid(F.col("margin")), 6).alias("p"), F.concat_ws(",", "leaves").alias("leaves"))


def boosted_split(spark, d):
    model = B.boost(T.flagged(spark, d), ["l_quantity", "l_discount", "l_tax"], "y", B.Params(rounds=1, depth=1))
    t = model.table(spark).filter("node = 0").select("feature", "threshold", F.round("gain", 5).alias("gain"))
    leaves = model.table(spark).filter("node > 0").groupBy().pivot("node", [1, 2]).agg(F.round(F.first("weight"), 6)).toDF("left_weight", "right_weight")
    return t.join(leaves)


FIRST_SPLIT = """WITH p AS (SELECT l_quantity, l_discount, l_tax, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS y FROM lineitem),
f AS (SELECT 1 AS k, 'l_quantity' AS feature, l_quantity AS x, y FROM p UNION ALL SELECT 2, 'l_discount', l_discount, y FROM p UNION ALL SELECT 3, 'l_tax', l_tax, y FROM p),
s AS (SELECT k, feature, x, sum(sum(y)) OVER w AS y1, sum(count(*)) OVER w AS n1, sum(sum(y)) OVER (PARTITION BY k) AS y0, sum(count(*)) OVER (PARTITION BY k) AS n0 FROM f GROUP BY k, feature, x WINDOW w AS (PARTITION BY k ORDER BY x)),
g AS (SELECT k, feature, x, y1 * y1 / (n1 + 1) + (y0 - y1) * (y0 - y1) / (n0 - n1 + 1) - y0 * y0 / (n0 + 1) AS gain, 0.3 * y1 / (n1 + 1) AS a, 0.3 * (y0 - y1) / (n0 - n1 + 1) AS b FROM s WHERE n1 < n0)
SELECT feature, x::DOUBLE AS threshold, round(gain::DOUBLE, 5) AS gain, round(a::DOUBLE, 6) AS left_weight, round(b::DOUBLE, 6) AS right_weight FROM g ORDER BY gain DESC, k, x LIMIT 1"""


def boosted_importance(spark, d):
    model = B.boost(T.flagged(spark, d), NUMERIC, "l_extendedprice", B.Params(rounds=2, depth=3))
    return model.table(spark)


def linear_svc(spark, d):
    from pyspark.ml.classification import LinearSVC

    rows = M.features(T.flagged(spark, d), NUMERIC)
    return LinearSVC(labelCol="y", maxIter=10, regParam=0.01).fit(rows).transform(rows).select("l_orderkey", "l_linenumber", F.col("prediction").cast("int").alias("prediction"))


def logistic(spark, d):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    rows = M.features(T.flagged(spark, d), NUMERIC)
    return LogisticRegression(labelCol="y", maxIter=20).fit(rows).transform(rows).select("l_orderkey", "l_linenumber", F.round(vector_to_array("probability")[1], 6).alias("p"))


def forest(spark, d):
    from pyspark.ml.classification import RandomForestClassifier

    rows = M.features(T.flagged(spark, d), NUMERIC)
    return RandomForestClassifier(labelCol="y", numTrees=5, maxDepth=4, seed=7).fit(rows).transform(rows).select("l_orderkey", "l_linenumber", F.col("prediction").cast("int").alias("prediction"))


def tree(spark, d):
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = M.features(T.flagged(spark, d), NUMERIC)
    return DecisionTreeRegressor(labelCol="l_extendedprice", featuresCol="features", maxDepth=4, leafCol="leaf").fit(M.features(rows.drop("features"), NUMERIC[:1])).transform(M.features(rows.drop("features"), NUMERIC[:1])).select("l_orderkey", "l_linenumber", F.col("leaf").cast("int").alias("leaf"))


def als(spark, d):
    from pyspark.ml.recommendation import ALS

    rows = T.bought(spark, d).select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item"), F.col("quantity").cast("float").alias("rating"))
    model = ALS(userCol="user", itemCol="item", ratingCol="rating", rank=8, maxIter=4, seed=7).fit(rows)
    users, items = (side.select("id", F.col("features").alias("vec")) for side in (model.userFactors, model.itemFactors))
    found = top_products(users, items, 3)
    return found.select(F.col("query").cast("int").alias("user"), (F.col("place") - 1).alias("place"), F.col("candidate").cast("int").alias("item"), F.col("score").cast("float").alias("rating"))


def sequences(spark, d):
    from pyspark.ml.fpm import PrefixSpan

    rows = T.load(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e")).select(F.transform("e", lambda x: F.array(x["event_type"])).alias("sequence"))
    return PrefixSpan(minSupport=0.3, maxPatternLength=3).findFrequentSequentialPatterns(rows).select(F.array_join(F.flatten("sequence"), ">").alias("pattern"), "freq")


def topics(spark, d):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import HashingTF

    words = T.load(spark, d, "documents").select("doc_id", F.split("text", r"\s+").alias("words"))
    rows = HashingTF(inputCol="words", outputCol="features", numFeatures=2048).transform(words)
    model = LDA(k=4, maxIter=3, seed=7, optimizer="online", subsamplingRate=1.0).fit(rows)
    return model.describeTopics(8).select("topic", F.posexplode("termIndices").alias("place", "term"))


def _kmeans_sql(rounds: int = 3) -> str:
    """Lloyd rounds from the first four points; the nearest centre, of equally near ones the smallest number."""
    made = ["p AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)", "c0 AS MATERIALIZED (SELECT id::INTEGER AS cluster, v FROM p WHERE id < 4)"]
    for k in range(1, rounds + 1):
        made.append(f"""c{k} AS MATERIALIZED (SELECT cluster, list(x ORDER BY i) AS v FROM (SELECT cluster, i, avg(v[i]) AS x FROM (SELECT p.id, p.v, arg_min(c.cluster, (list_distance(p.v, c.v), c.cluster)) AS cluster FROM p, c{k - 1} c GROUP BY 1, 2), (SELECT unnest(range(1, (SELECT max(len(v)) FROM p) + 1)) AS i) GROUP BY 1, 2) GROUP BY 1)""")
    return f"WITH {', '.join(made)} SELECT cluster, (i - 1)::INTEGER AS i, round(v[i], 5) AS x FROM c{rounds}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM p) + 1)) AS i)"


def _dbscan_sql() -> str:
    ways = "SELECT a.id AS src, b.other AS dst FROM core a JOIN close b ON a.id = b.id JOIN core c ON c.id = b.other"
    return f"""WITH pts AS MATERIALIZED (SELECT p_partkey AS id, p_size / 10.0::DOUBLE AS x, p_retailprice / 50.0::DOUBLE AS y FROM part),
close AS MATERIALIZED (SELECT a.id, b.id AS other FROM pts a, pts b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.25), core AS MATERIALIZED (SELECT id FROM close GROUP BY id HAVING count(*) >= 4),
{_component_sql(ways, 14)}, border AS (SELECT close.id, min(component) AS component FROM close JOIN comp ON comp.id = close.other WHERE close.id NOT IN (SELECT id FROM core) GROUP BY 1)
SELECT id, coalesce(c.component, b.component) AS label, CASE WHEN c.id IS NOT NULL THEN 0 WHEN b.id IS NOT NULL THEN 1 ELSE -1 END AS prediction FROM pts LEFT JOIN comp c USING (id) LEFT JOIN border b USING (id)"""


def _simrank_sql(rounds: int = 2) -> str:
    made = ["e AS MATERIALIZED (SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", "wi AS MATERIALIZED (SELECT u, i, 1.0::DOUBLE / count(*) OVER (PARTITION BY i) AS w FROM e)", "wu AS MATERIALIZED (SELECT u, i, 1.0::DOUBLE / count(*) OVER (PARTITION BY u) AS w FROM e)", "u0 AS (SELECT DISTINCT u AS a, u AS b, 1.0::DOUBLE AS s FROM e)", "i0 AS (SELECT DISTINCT i AS a, i AS b, 1.0::DOUBLE AS s FROM e)"]
    for k in range(1, rounds + 1):
        for new, old, x, y, w in (("u", "i", "u", "i", "wu"), ("i", "u", "i", "u", "wi")):
            made.append(f"h{new}{k} AS MATERIALIZED (SELECT {x} AS x, s.b, sum(s.s * w) AS s FROM {old}{k - 1} s JOIN {w} ON {y} = s.a GROUP BY 1, 2), {new}{k} AS MATERIALIZED (SELECT h.x AS a, {x} AS b, CASE WHEN h.x = {x} THEN 1.0 ELSE 0.6::DOUBLE * sum(h.s * w) END AS s FROM h{new}{k} h JOIN {w} ON {y} = h.b GROUP BY 1, 2)")
    return f"WITH {', '.join(made)} SELECT side, a, count(*) AS n, round(sum(s), 6) AS total FROM (SELECT 'user' AS side, a, b, s FROM u{rounds} UNION ALL SELECT 'item', a, b, s FROM i{rounds}) WHERE a < b GROUP BY 1, 2"


#: Patterns of one to three events by the earliest places at which they end; support 0.3 of the users.
SEQUENCES = """WITH s AS MATERIALIZED (SELECT user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, event_type) AS k FROM events),
f1 AS MATERIALIZED (SELECT user_id, t AS p, min(k) AS k FROM s GROUP BY 1, 2), f2 AS MATERIALIZED (SELECT f.user_id, f.p || '>' || s.t AS p, min(s.k) AS k FROM f1 f JOIN s ON s.user_id = f.user_id AND s.k > f.k GROUP BY 1, 2),
f3 AS (SELECT f.user_id, f.p || '>' || s.t AS p, min(s.k) AS k FROM f2 f JOIN s ON s.user_id = f.user_id AND s.k > f.k GROUP BY 1, 2)
SELECT p AS pattern, count(*) AS freq FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3) GROUP BY 1 HAVING count(*) >= ceil(0.3 * (SELECT count(DISTINCT user_id) FROM events))"""


def windows(spark, d):
    from tessera.streaming.windows import streaming_counts

    return streaming_counts(T.load(spark, d, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {
    "stats_covariance": (covariance, _pair_sql("covar_samp({a}, {b})").replace(", 6)", ", 4)")),
    "stats_gram": (gram, _pair_sql("sum({a} * {b})").replace(", 6)", ", 0)")),
    "stats_pearson": (pearson, _pair_sql("corr({a}, {b})")),
    "stats_spearman": (spearman, "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS l_quantity, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS l_discount FROM lineitem) SELECT 'l_quantity' AS a, 'l_quantity' AS b, 1.0::DOUBLE AS value UNION ALL SELECT 'l_discount', 'l_discount', 1.0 UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM r"),
    "stats_summary": (summary, " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 6) AS mean, round(var_samp({c}), 4) AS variance, count(*) FILTER ({c} <> 0) AS non_zeros, min({c}) AS least, max({c}) AS most FROM lineitem" for c in NUMERIC)),
    "stats_cosine_columns": (cosine, " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b})), 6) AS value FROM lineitem" for a, b in PAIRS if a != b)),
    "stats_regression": (regression, "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem"),
    "stats_principal_components": (components, None),
    "knn_neighbours": (neighbours, f"WITH {NEAR} SELECT query, neighbour, round(distance, 5) AS distance, place::INTEGER AS place FROM k WHERE place <= 5"),
    "knn_classify": (neighbour_class, f"WITH {NEAR}, v AS (SELECT query, label, count(*) AS n FROM k WHERE place <= 5 GROUP BY 1, 2) SELECT query, label FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, label) AS p FROM v) WHERE p = 1"),
    "text_document_frequency": (word_frequency, f"WITH {WORDS} SELECT lang, word, count(*) AS df FROM w WHERE word <> '' GROUP BY 1, 2"),
    "text_idf": (idf, f"WITH {WORDS}, f AS (SELECT word, count(DISTINCT doc_id) AS df FROM w WHERE word <> '' GROUP BY 1), m AS (SELECT count(*) AS m FROM documents) SELECT word, CASE WHEN df >= 2 THEN round(ln((m + 1)::DOUBLE / (df + 1)), 6) ELSE 0 END AS idf FROM f, m"),
    "cluster_kmeans": (kmeans, _kmeans_sql()),
    "cluster_dbscan": (dbscan, _dbscan_sql()),
    "recommend_simrank": (simrank, _simrank_sql()),
    "recommend_als": (als, None),
    "mine_sequences": (sequences, SEQUENCES),
    "text_topics": (topics, None),
    "tree_splits": (splits, f"WITH {SCORED}, b AS (SELECT l_quantity AS t, count(*) AS n, sum(y) AS pos FROM p GROUP BY 1), c AS (SELECT t, sum(n) OVER (ORDER BY t) AS ln, sum(pos) OVER (ORDER BY t) AS lp, sum(n) OVER () AS tn, sum(pos) OVER () AS tp FROM b) SELECT t AS threshold, ln::BIGINT AS left_n, round(2 * (tp / tn) * (1 - tp / tn) - ln / tn * (2 * (lp / ln) * (1 - lp / ln)) - (tn - ln) / tn * (2 * ((tp - lp) / (tn - ln)) * (1 - (tp - lp) / (tn - ln))), 7) AS gain FROM (SELECT t, ln::DOUBLE AS ln, lp::DOUBLE AS lp, tn::DOUBLE AS tn, tp::DOUBLE AS tp FROM c) WHERE ln < tn"),
    "metric_elementwise": (metrics, f"WITH {SCORED} SELECT round(sqrt(avg(power(q - y, 2))), 6) AS rmse, round(sqrt(avg(power(ln(1 + q) - ln(1 + y), 2))), 6) AS rmsle, round(avg(abs(q - y)), 6) AS mae, round(avg(CASE WHEN q > 0.5 THEN 1 - y ELSE y END), 6) AS error FROM p"),
    "metric_auc": (auc, f"WITH {SCORED}, b AS (SELECT q, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY 1), c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY q) - neg AS below FROM b) SELECT round((sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)))::DOUBLE, 9) AS auc FROM c"),
    "metric_ranking": (ranking, f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, l_linenumber, l_extendedprice, l_discount, l_tax) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY y DESC, l_linenumber, l_extendedprice, l_discount, l_tax) AS ik FROM p), h AS (SELECT *, sum(y) OVER (PARTITION BY l_orderkey ORDER BY k) AS hits FROM r)
        SELECT l_orderkey, round(sum(CASE WHEN k <= 3 THEN y ELSE 0 END) / 3.0, 4)::DOUBLE AS pre, round(coalesce(sum(CASE WHEN k <= 3 THEN y / log2(k + 1) ELSE 0 END) / nullif(sum(CASE WHEN ik <= 3 THEN y / log2(ik + 1) ELSE 0 END), 0), 1), 4) AS ndcg,
        round(coalesce(sum(CASE WHEN k <= 3 AND y > 0 THEN hits::DOUBLE / k ELSE 0 END) / nullif(least(sum(y), 3), 0), 1), 4) AS map FROM h GROUP BY 1"""),
    "boost_objectives": (objectives, f"""WITH {SCORED} SELECT 'squared_error' AS objective, round(sum(q - y), 3) AS gradient, round(sum(1.0::DOUBLE), 3) AS hessian FROM p
        UNION ALL SELECT 'squared_log_error', round(sum((ln(1 + q) - ln(1 + y)) / (q + 1)), 3), round(sum(greatest((1 - ln(1 + q) + ln(1 + y)) / power(q + 1, 2), 1e-6)), 3) FROM p
        UNION ALL SELECT 'logistic', round(sum(1 / (1 + exp(-q)) - y), 3), round(sum(greatest(1 / (1 + exp(-q)) * (1 - 1 / (1 + exp(-q))), 1e-16)), 3) FROM p
        UNION ALL SELECT 'hinge', round(sum(CASE WHEN q * (2 * y - 1) < 1 THEN -(2 * y - 1)::DOUBLE ELSE 0 END), 3), round(sum(CASE WHEN q * (2 * y - 1) < 1 THEN 1.0::DOUBLE ELSE 1e-16 END), 3) FROM p
        UNION ALL SELECT 'poisson', round(sum(exp(q) - y), 3), round(sum(exp(q + 0.7)), 3) FROM p"""),
    "boost_classify": (boosted, None),
    "boost_first_split": (boosted_split, FIRST_SPLIT),
    "boost_model_table": (boosted_importance, None),
    "learn_linear_svc": (linear_svc, None),
    "learn_logistic": (logistic, None),
    "learn_forest": (forest, None),
    "learn_tree_leaves": (tree, None),
    "stream_windows": (windows, "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
}
