"""Boosting objectives as gradient and hessian columns, and metrics as aggregates.

``p`` is the raw margin unless said otherwise, ``y`` the label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.running import log_gamma, running_sums

#: Smallest hessian of the logistic objectives.
TINY = 1e-16
#: Least margin of the squared log error, whose logarithm ends at -1.
LEAST_MARGIN = -1 + 1e-6


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logistic(p: Column, y: Column) -> tuple[Column, Column]:
    s = sigmoid(p)
    return s - y, F.greatest(s * (1 - s), F.lit(TINY))


def _hinge(p: Column, y: Column) -> tuple[Column, Column]:
    side = 2 * y - 1
    return F.when(p * side < 1, -side).otherwise(0.0), F.when(p * side < 1, 1.0).otherwise(TINY)


def _squared_log(p: Column, y: Column) -> tuple[Column, Column]:
    p = F.greatest(p, F.lit(LEAST_MARGIN))
    apart = F.log1p(p) - F.log1p(y)
    return apart / (p + 1), F.greatest((1 - apart) / F.pow(p + 1, 2), F.lit(1e-6))


def tweedie(power: float = 1.5) -> Callable[[Column, Column], tuple[Column, Column]]:
    def loss(p: Column, y: Column) -> tuple[Column, Column]:
        a, b = F.exp((1 - power) * p), F.exp((2 - power) * p)
        return b - y * a, (2 - power) * b - y * (1 - power) * a

    return loss


#: name: (margin, label) to (gradient, hessian).
OBJECTIVES: dict[str, Callable[[Column, Column], tuple[Column, Column]]] = {
    "squared_error": lambda p, y: (p - y, F.lit(1.0)),
    "squared_log_error": _squared_log,
    "logistic": _logistic,
    "hinge": _hinge,
    "poisson": lambda p, y: (F.exp(p) - y, F.exp(p + 0.7)),
    "gamma": lambda p, y: (1 - y / F.exp(p), y / F.exp(p)),
    "tweedie": tweedie(),
}

#: Metrics of (prediction, label, weight); predictions are probabilities or values. Larger is better for MAXIMISE.
METRICS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "rmse": lambda p, y, w: F.sqrt(F.sum(w * F.pow(p - y, 2)) / F.sum(w)),
    "rmsle": lambda p, y, w: F.sqrt(F.sum(w * F.pow(F.log1p(p) - F.log1p(y), 2)) / F.sum(w)),
    "mae": lambda p, y, w: F.sum(w * F.abs(p - y)) / F.sum(w),
    "logloss": lambda p, y, w: F.sum(-w * (y * F.log(F.greatest(p, F.lit(1e-16))) + (1 - y) * F.log(F.greatest(1 - p, F.lit(1e-16))))) / F.sum(w),
    "error": lambda p, y, w: F.sum(w * F.when(p > 0.5, 1 - y).otherwise(y)) / F.sum(w),
    "gamma_deviance": lambda p, y, w: 2 * F.sum(w * (y / (p + 1e-9) - F.log(y / (p + 1e-9)) - 1)),
    "gamma_nloglik": lambda p, y, w: F.sum(w * (y / p + F.log(p))) / F.sum(w),
    "poisson_nloglik": lambda p, y, w: F.sum(w * (log_gamma(y + 1) + p - y * F.log(p))) / F.sum(w),
    "tweedie_nloglik": lambda p, y, w: F.sum(w * (F.exp(0.5 * F.log(p)) / 0.5 + y * F.exp(-0.5 * F.log(p)) / 0.5)) / F.sum(w),
}
MAXIMISE = ("auc", "aucpr", "ndcg", "map", "pre")


def metric(name: str) -> Callable[[Column, Column, Column], Column]:
    """One of METRICS; ``error@t`` predicts the first class above t, ``tweedie_nloglik@r`` has the variance power r in (1, 2)."""
    kind, _, at = name.partition("@")
    if not at:
        return METRICS[name]
    x = float(at)
    if kind == "error":
        return lambda p, y, w: F.sum(w * F.when(p > x, 1 - y).otherwise(y)) / F.sum(w)
    if kind == "tweedie_nloglik" and 1 < x < 2:
        return lambda p, y, w: F.sum(w * (F.exp((2 - x) * F.log(p)) / (2 - x) - y * F.exp((1 - x) * F.log(p)) / (1 - x))) / F.sum(w)
    raise ValueError(f"no metric {name}")


def evaluate(df: DataFrame, prediction: str, label: str, names: list[str], weight: str | None = None) -> DataFrame:
    """One row with a column for each metric, in one pass."""
    p, y = F.col(prediction).cast("double"), F.col(label).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.agg(*(metric(n)(p, y, w).alias(n) for n in names))


def auc(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """One row, auc, from counts by distinct prediction (ties count a half)."""
    by = df.groupBy(F.col(prediction).alias("p")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    below = running_sums(by, "p", {"upto": "neg"}).withColumn("below", F.col("upto") - F.col("neg"))
    return below.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def ranking(df: DataFrame, group: str, prediction: str, label: str, at: int) -> DataFrame:
    """group, pre, ndcg, map at a cut; ties in the prediction go to the row column ``row`` in ascending order."""
    best = Window.partitionBy(group).orderBy(F.desc(prediction), "row")
    ideal = Window.partitionBy(group).orderBy(F.desc(label), "row")
    upto = best.rowsBetween(Window.unboundedPreceding, 0)
    r = df.withColumns({"place": F.row_number().over(best), "best_place": F.row_number().over(ideal)})
    r = r.withColumn("hits", F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).over(upto))
    gain = F.pow(F.lit(2.0), F.col(label)) - 1
    top, top_ideal = F.col("place") <= at, F.col("best_place") <= at
    return r.groupBy(group).agg(
        (F.sum(F.when(top & (F.col(label) > 0), 1).otherwise(0)) / at).alias("pre"),
        F.coalesce(F.try_divide(F.sum(F.when(top, gain / F.log2(F.col("place") + 1)).otherwise(0.0)), F.sum(F.when(top_ideal, gain / F.log2(F.col("best_place") + 1)).otherwise(0.0))), F.lit(1.0)).alias("ndcg"),
        F.coalesce(F.try_divide(F.sum(F.when(top & (F.col(label) > 0), F.col("hits") / F.col("place")).otherwise(0.0)), F.least(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)), F.lit(at))), F.lit(1.0)).alias("map"),
    )
