"""Statistics and linear algebra over named numeric columns, and weights of words."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.running import running_sums
from tessera.functions.storage import cut


def _moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """One pass: of each pair of columns the moments over the rows where both are there, as one row.

    n_a_b rows, m_a_b and m_b_a means of a and of b, v_a_b and v_b_a variances of a and of b, c_a_b covariances, g_a_b sums of
    products, and q_a_b and q_b_a sums of squares of a and of b.
    """
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    made = []
    for a, b in combinations_with_replacement(cols, 2):
        both = x[a].isNotNull() & x[b].isNotNull()
        made += [F.count(F.when(both, 1)).alias(f"n_{a}_{b}"), F.covar_samp(x[a], x[b]).alias(f"c_{a}_{b}"), F.sum(x[a] * x[b]).alias(f"g_{a}_{b}")]
        for p, q in dict.fromkeys([(a, b), (b, a)]):
            own = F.when(both, x[p])
            made += [F.avg(own).alias(f"m_{p}_{q}"), F.var_samp(own).alias(f"v_{p}_{q}"), F.sum(own * own).alias(f"q_{p}_{q}")]
    return df.agg(*made)


def _pairs(df: DataFrame, cols: list[str], value) -> DataFrame:
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value(a, b).cast("double").alias("value")) for a, b in combinations_with_replacement(cols, 2)]
    return _moments(df, cols).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def covariance(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, value: sample covariances (upper triangle), each over the rows where both columns are there."""
    return _pairs(df, cols, lambda a, b: F.col(f"c_{a}_{b}"))


def gram(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, value: sums of products (upper triangle)."""
    return _pairs(df, cols, lambda a, b: F.col(f"g_{a}_{b}"))


def _correlation(a: str, b: str) -> Column:
    va, vb = F.col(f"v_{a}_{b}"), F.col(f"v_{b}_{a}")
    zero = (F.abs(va) <= 1e-12) | (F.abs(vb) <= 1e-12)
    return F.lit(1.0) if a == b else F.when(zero, F.lit(float("nan"))).otherwise(F.try_divide(F.col(f"c_{a}_{b}"), F.sqrt(va * vb)))


def pearson(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, value: correlations over the rows where both columns are there; NaN with a constant column, 1 on the diagonal."""
    return _pairs(df, cols, _correlation)


def spearman(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlations of average ranks.

    Ranks come from counts by value: a running sum over the distinct values of a column, not a sort of all rows. A pair of
    columns is ranked over the rows where both are there, so columns with nulls are ranked for each pair anew.
    """
    holed = {c for c, n in df.agg(*(F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in cols)).first().asDict().items() if n}
    whole = [c for c in cols if c not in holed]
    parts = [_ranked_pearson(df, whole)] if whole else []
    for a, b in combinations_with_replacement(cols, 2):
        if a in holed or b in holed:
            both = df.filter(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull())
            parts.append(_ranked_pearson(both, list(dict.fromkeys([a, b]))).filter((F.col("a") == a) & (F.col("b") == b)))
    return reduce(DataFrame.unionByName, parts)


def _ranked_pearson(df: DataFrame, cols: list[str]) -> DataFrame:
    out = df.select(*(F.col(f"`{c}`") for c in cols))
    for c in cols:
        counts = cut(out.groupBy(F.col(f"`{c}`").alias("_v")).agg(F.count("*").alias("_n")))
        ranks = running_sums(counts, "_v", {"_upto": "_n"}).select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"_r_{c}"))
        out = out.join(ranks, F.col(f"`{c}`") == F.col("_v")).drop("_v")
    return pearson(out.select(*(F.col(f"`_r_{c}`").alias(c) for c in cols)), cols)


def summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """name, n, mean, variance, non_zeros, least, most, norm_l1, norm_l2."""
    made = []
    for c in cols:
        x = F.col(c).cast("double")
        made.append(F.struct(F.lit(c).alias("name"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.count(F.when(x != 0, 1)).alias("non_zeros"), F.min(x).alias("least"), F.max(x).alias("most"), F.sum(F.abs(x)).alias("norm_l1"), F.sqrt(F.sum(x * x)).alias("norm_l2")).alias(c))
    return df.agg(*made).select(F.explode(F.array(*cols)).alias("r")).select("r.*")


def cosine_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, value: cosine similarity of columns over the rows where both are there."""
    return _pairs(df, cols, lambda a, b: F.try_divide(F.col(f"g_{a}_{b}"), F.sqrt(F.col(f"q_{a}_{b}") * F.col(f"q_{b}_{a}")))).filter("a <> b")


def regression(df: DataFrame, target: str, feature: str) -> DataFrame:
    """slope, intercept of least squares by moments in one pass, over the rows where both columns are there."""
    m = _moments(df, [feature, target])
    slope = F.try_divide(F.col(f"c_{feature}_{target}"), F.col(f"v_{feature}_{target}"))
    return m.select(slope.alias("slope"), (F.col(f"m_{target}_{feature}") - slope * F.col(f"m_{feature}_{target}")).alias("intercept"))


def principal_components(df: DataFrame, cols: list[str], k: int) -> tuple[list[float], list[list[float]]]:
    """Explained variance shares and loadings (one list a component, largest entry positive), from the covariances.

    Only rows where all columns are there count, so that the covariances belong together.
    """
    import numpy as np

    at = {c: i for i, c in enumerate(cols)}
    matrix = np.zeros((len(cols), len(cols)))
    for r in covariance(df.dropna(subset=cols), cols).collect():  # as many rows as pairs of columns
        matrix[at[r["a"]], at[r["b"]]] = matrix[at[r["b"]], at[r["a"]]] = r["value"]
    values, vectors = np.linalg.eigh(matrix)
    best = np.argsort(-values)[:k]
    signs = [1.0 if vectors[np.argmax(np.abs(vectors[:, j])), j] > 0 else -1.0 for j in best]
    return (values[best] / values.sum()).tolist(), [(s * vectors[:, j]).tolist() for s, j in zip(signs, best, strict=True)]


def distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def document_frequency(docs: DataFrame) -> DataFrame:
    """lang, word, df: documents of a language that hold a word (white-space words)."""
    words = docs.select("lang", F.explode(F.array_distinct(F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != ""))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count("*").alias("df"))


def inverse_document_frequency(docs: DataFrame, least: int = 1) -> DataFrame:
    """word, idf = ln((m + 1) / (df + 1)), 0 below ``least`` documents."""
    df = document_frequency(docs.withColumn("lang", F.lit(""))).select("word", "df")
    m = docs.agg(F.count("*").alias("m"))
    return df.join(F.broadcast(m)).select("word", F.when(F.col("df") >= least, F.log((F.col("m") + 1) / (F.col("df") + 1))).otherwise(0.0).alias("idf"))


def tf_idf(docs: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, word, tf, tf_idf: a row for each word of a document; its count times its inverse document frequency."""
    words = docs.select("doc_id", F.explode(F.filter(F.split("text", "[ \t\n\r]+"), lambda w: w != "")).alias("word"))
    counts = words.groupBy("doc_id", "word").agg(F.count("*").alias("tf"))
    return counts.join(inverse_document_frequency(docs, least), "word").select("doc_id", "word", "tf", (F.col("tf") * F.col("idf")).alias("tf_idf"))
