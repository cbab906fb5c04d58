"""Areas under curves by group and weight, and the approximate median significance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.running import places, running_sums

#: What is added to the background of the approximate median significance. A fixed value.
BACKGROUND = 10.0


def areas(df: DataFrame, prediction: str, label: str, weight: str | None = None, group: str | None = None) -> DataFrame:
    """group, auc, aucpr of each group (one, null, without ``group``) by weights; null where a class is missing.

    Labels are from 0 to 1, the share of a row in the first class. Rows with a null prediction, label or weight are left
    out; equal predictions count together. Rows are added up by group and prediction first, so a hot group costs its
    distinct predictions, which are spread over tasks.
    """
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    y, p = F.col(f"`{label}`").cast("double"), F.col(f"`{prediction}`").cast("double")
    rows = df.select((F.col(f"`{group}`") if group else F.lit(None).cast("int")).alias("group"), p.alias("p"), (w * y).alias("pos"), (w * (1 - y)).alias("neg"))
    by = rows.filter("p is not null and pos is not null").groupBy("group", "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    run = places(by.withColumn("g", F.struct("group")), "g", [F.desc("p")], {"tp": F.col("pos"), "fp": F.col("neg")})
    below = F.col("pos") * F.lit(1.0), F.col("fp") - F.col("neg") / 2
    sums = run.groupBy("group").agg(F.sum("pos").alias("ps"), F.sum("neg").alias("ns"), F.sum(below[0] * below[1]).alias("lost"), F.sum(F.col("pos") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).alias("kept"))
    both = (F.col("ps") > 0) & (F.col("ns") > 0)
    return sums.select("group", F.when(both, 1 - F.col("lost") / (F.col("ps") * F.col("ns"))).alias("auc"), F.when(F.col("ps") > 0, F.col("kept") / F.col("ps")).alias("aucpr"))


def ams(df: DataFrame, prediction: str, label: str, share: float = 1.0, weight: str | None = None) -> DataFrame:
    """One row, ams: the approximate median significance of the ``share`` of rows with the largest predictions.

    With a share of 1 (or one that is less than a row) the best over all cuts between distinct predictions. Where the share
    ends within equal predictions, they count in part. Rows with a null prediction, label or weight are left out.
    """
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    y, p = F.col(f"`{label}`").cast("double") > 0.5, F.col(f"`{prediction}`").cast("double")
    rows = df.select(p.alias("p"), F.when(y, w).otherwise(0.0).alias("s"), F.when(y, 0.0).otherwise(w).alias("b")).filter(p.isNotNull() & y.isNotNull() & w.isNotNull())
    by = rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.sum("b").alias("b"))
    run = running_sums(by, "p", {"n_upto": "n", "s_upto": "s", "b_upto": "b"}, descending=True)
    total = by.agg(F.sum("n").alias("all"))

    def value(s, b):
        return F.sqrt(2 * ((s + b + BACKGROUND) * F.log(1 + s / (b + BACKGROUND)) - s))

    run = run.join(F.broadcast(total)).withColumn("top", F.floor(share * F.col("all")))
    whole = (F.col("top") == 0) | (F.col("top") == F.col("all"))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("top") - F.col("n_upto") + F.col("n")) / F.col("n")))
    cuts = F.max(F.when(F.col("n_upto") < F.col("all"), value(F.col("s_upto"), F.col("b_upto"))))
    return run.agg(F.when(F.first(whole), F.coalesce(cuts, F.lit(0.0))).otherwise(value(F.sum(F.col("s") * part), F.sum(F.col("b") * part))).alias("ams"))
