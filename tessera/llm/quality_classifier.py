"""Quality classifier by hierarchical empirical Bayes.

A document classifier, fitted on labelled documents, gives each document its evidence. The documents' probabilities
are summed by path and by host; a host's good share is shrunk towards the global one and a path's towards its
host's. The strength of each level is estimated from how much its sites differ beyond what their sampling explains.
A document's posterior adds its evidence to the prior odds of its path, its own share in them taken out, so that
sparse sites hardly move it.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, shared_dir

#: Labelled rows that the document classifier is fitted on at most: those of the smallest hashes.
TRAINING_ROWS = 20_000
FEATURES = 1 << 15
#: Sites up to which their table is broadcast; beyond, they are joined by a salted key, this many salts a site.
MOST_SITES, SALTS = 200_000, 32
#: Bounds of a level's strength, in documents.
WEAKEST, STRONGEST = 2.0, 1e4
BLANKS = r"[\x20\x09-\x0D]+"
RESULT = ("p_document", "p_toxic", "p_path", "p_good", "kept")
SHAPES = ("words", "mean_length", "symbols", "upper", "digits", "lines", "distinct", "stops", "shouts")


def _share(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, keep, "")) / F.greatest(F.length(text), F.lit(1))


def featurise(docs: DataFrame) -> DataFrame:
    """Add the words' hashed presence and shares of the text's shape as the vector ``features``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.split(F.lower(text), BLANKS)
    n = F.greatest(F.size("_words"), F.lit(1))
    shaped = docs.withColumn("_t", text).withColumn("_words", words)
    shaped = shaped.withColumns(
        {
            "words": F.log1p(F.size("_words").cast("double")) / 4,
            "mean_length": F.length("_t") / n / 8,
            "symbols": _share(F.col("_t"), r"[^#*$%&|<>{}=~^]+") * 10,
            "upper": _share(F.col("_t"), r"[^\p{Lu}]+") * 5,
            "digits": _share(F.col("_t"), r"[^0-9]+") * 5,
            "lines": (F.size(F.split("_t", "\n")) / n) * 2,
            "distinct": F.size(F.array_distinct("_words")) / n * 3,
            "stops": _share(F.col("_t"), r"[^.,]+") * 20,
            "shouts": _share(F.col("_t"), r"[^!]+") * 10,
        }
    )
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_words", outputCol="_hashed").transform(shaped)
    return VectorAssembler(inputCols=[*SHAPES, "_hashed"], outputCol="features", handleInvalid="keep").transform(hashed).drop("_t", "_words", "_hashed", *SHAPES)


def fit(docs: DataFrame, labels: DataFrame) -> list[tuple[str, object]]:
    """A logistic regression for good quality and one for toxicity, where the labels hold both kinds.

    The labels used are at most TRAINING_ROWS, which is why they can be broadcast and no text is shuffled. Of labels
    that repeat a document the lowest quality and the highest toxicity count.
    """
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    sample = materialise(featurise(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")).select("features", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic")), shared_dir(docs.sparkSession), "training").cache()
    models = []
    for name, target in (("good", "quality"), ("toxic", "toxic")):
        rows = sample.filter(f"{target} in (0, 1)")
        if rows.select(target).distinct().count() == 2:
            models.append((name, LogisticRegression(labelCol=target, regParam=0.002, maxIter=40, standardization=False, rawPredictionCol=f"_{name}_raw", probabilityCol=f"_{name}_p", predictionCol=f"_{name}_class").fit(rows)))
    sample.unpersist()
    return models


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(mean: float, between: float) -> float:
    """Pseudo-documents of a beta prior about ``mean`` with the variance ``between``: few if sites differ."""
    return min(STRONGEST, max(WEAKEST, mean * (1 - mean) / between - 1)) if between > 0 else STRONGEST


def strengths(sites: DataFrame) -> tuple[float, float, float]:
    """The global mean, and the strengths of the priors of hosts and of paths within hosts.

    ``sites``: _host, _path, n, s and q (documents, sum and sum of squares of their probabilities). Variances between
    sites are those of an analysis of variance: squares about the mean less what the variance within paths explains.
    """
    hosts = sites.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("k"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("paths"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    squares = F.col("s") * F.col("s") / F.col("n")
    t = hosts.agg(*(F.sum(x).alias(name) for name, x in {"n": "n", "s": "s", "q": "q", "paths": "paths", "k": "k", "hosts": squares, "path_nn": F.col("nn") / F.col("n"), "host_nn": F.col("n") * F.col("n")}.items()), F.count("*").alias("h")).first()
    if not t["n"]:
        return 0.5, STRONGEST, STRONGEST
    mean = min(0.999, max(0.001, t["s"] / t["n"]))
    within = max(0.0, t["q"] - t["paths"]) / max(1, t["n"] - t["k"])
    of_paths = (t["paths"] - t["hosts"] - (t["k"] - t["h"]) * within) / max(1e-9, t["n"] - t["path_nn"])
    of_hosts = (t["hosts"] - t["s"] ** 2 / t["n"] - (t["h"] - 1) * within) / max(1e-9, t["n"] - t["host_nn"] / t["n"])
    return mean, _strength(mean, of_hosts), _strength(mean, of_paths)


def score(docs: DataFrame, models: list[tuple[str, object]], host: str, path: str, carry: list[str]) -> DataFrame:
    """Posterior probabilities of each row: columns of ``carry``, p_document, p_toxic, p_path, p_good and kept."""
    from pyspark.ml.functions import vector_to_array

    folder = shared_dir(docs.sparkSession)
    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    rows = featurise(docs.select(F.struct(*(F.col(f"`{c}`") for c in carry if c not in RESULT)).alias("row"), "text", site(host).alias("_host"), site(path).alias("_path")))
    evidence = {"good": F.lit(0.0), "toxic": F.lit(-9.0)}
    for name, model in models:
        rows = model.transform(rows)
        evidence[name] = vector_to_array(f"_{name}_raw")[1]
    rows = rows.select("row", "_host", "_path", evidence["good"].alias("_good"), evidence["toxic"].alias("_toxic"))
    scored = materialise(rows.withColumn("_p", 1 / (1 + F.exp(-F.col("_good")))), folder, "scored")

    sites = materialise(scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("_p").alias("s"), F.sum(F.col("_p") * F.col("_p")).alias("q")), folder, "sites")
    mean, of_hosts, of_paths = strengths(sites)
    priors = sites.join(sites.groupBy("_host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")), "_host").select("_host", "_path", "n", "s", "host_n", "host_s")
    if sites.count() <= MOST_SITES:
        joined = scored.join(F.broadcast(priors), ["_host", "_path"])
    else:
        salted = priors.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = scored.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_path", "_salt"])
    host_share = (F.lit(of_hosts * mean) + F.col("host_s") - F.col("_p")) / (F.lit(of_hosts) + F.col("host_n") - 1)
    path_share = (F.lit(of_paths) * host_share + F.col("s") - F.col("_p")) / (F.lit(of_paths) + F.col("n") - 1)
    prior = F.greatest(F.lit(0.001), F.least(F.lit(0.999), path_share))
    odds = F.col("_good") - _logit(F.lit(mean)) + _logit(prior)
    good, toxic = 1 / (1 + F.exp(-odds)), 1 / (1 + F.exp(-F.col("_toxic")))
    return joined.select("row.*", F.col("_p").alias("p_document"), toxic.alias("p_toxic"), prior.alias("p_path"), good.alias("p_good"), ((good >= 0.5) & (toxic < 0.5)).alias("kept"))


def quality_classifier(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score every whole text: columns of ``carry``, p_document, p_toxic, p_path, p_good, kept.

    A document is kept if its posterior of good quality is at least a half and it is not judged toxic. A null text
    is an empty one; null hosts and paths are sites of their own, and so is all without such a column; repeated rows
    each give a row. Columns that are carried may have any name; one named as a result column gives way to it. Labels
    that are null are not used, and without both classes a head abstains (evidence 0: all are kept). An empty table
    gives an empty one. Only sums by site are shuffled, after partial aggregation; the sites are broadcast up to
    MOST_SITES, and beyond joined by a salted key, so that no site's documents meet in one task.
    """
    return score(docs, fit(docs, labels), host, path, list(carry))
