"""Running sums over an order, without moving all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.storage import cut

def ranged(df: DataFrame, key: str) -> DataFrame:
    """Write a table dealt by the order of ``key``, with the number of each row's part as ``_range``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, key).withColumn("_range", F.spark_partition_id()))


def sums_in_ranges(df: DataFrame, key: str, values: dict[str, str], descending: bool = False) -> DataFrame:
    """``running_sums`` of a table from ``ranged``, which keeps its ``_range``: several sums need no new order."""
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    totals = df.groupBy("_range").agg(*(F.sum(v).alias(f"_t_{n}") for n, v in values.items()))
    before = Window.orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values))
    inside = Window.partitionBy("_range").orderBy(way(key)).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(F.broadcast(totals), "_range")
    return joined.withColumns({n: F.sum(v).over(inside) + F.col(f"_o_{n}") for n, v in values.items()}).drop(*(f"_o_{n}" for n in values))


def running_sums(df: DataFrame, key: str, values: dict[str, str], descending: bool = False) -> DataFrame:
    """Add for each ``new: column`` the sum of the column over rows up to this one in the order of ``key``.

    ``key`` is numeric, distinct and not null. Rows are dealt into ranges and written, once; a window runs inside each range
    and the totals of the ranges before it, at most as many rows as shuffle partitions, are broadcast and added.
    """
    return sums_in_ranges(ranged(df, key), key, values, descending).drop("_range")


#: Rows of a group that a window of one task takes at most; where groups are larger, they are dealt into ranges.
WHOLE = 1 << 20


def largest(df: DataFrame, group: str) -> int:
    """Rows of the largest group, from counts alone."""
    return df.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def places(df: DataFrame, group: str, order: list[Column], values: dict[str, Column], name: str = "place", most: int | None = None) -> DataFrame:
    """Add each row's place in its group (from 1) and, for each new name, the sum of a value over the group up to the row.

    Rows are dealt into ranges of (group, order), so that a large group is many tasks' work; what a range lacks from those
    before it is broadcast: only groups that span ranges need it, of which each range has two at most. ``order`` must leave
    no ties. ``most`` is ``largest`` of the groups if the caller knows it: if no group is beyond WHOLE rows, a window over
    groups does, and what is asked next of the same groups needs no new shuffle.
    """
    if most is not None and most <= WHOLE:
        each = Window.partitionBy(group).orderBy(*order)
        sums = {n: F.sum(v).over(each.rowsBetween(Window.unboundedPreceding, 0)) for n, v in values.items()}
        return df.withColumns({name: F.row_number().over(each).cast("long")} | sums)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.withColumns({f"_v_{n}": v for n, v in values.items()}).repartitionByRange(parts, F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy(group, "_part").agg(F.count("*").alias("_c"), *(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values))
    whole, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spanning = totals.withColumn("_ranges", F.count("*").over(whole)).filter("_ranges > 1")
    offsets = spanning.select(group, "_part", F.sum("_c").over(before).alias("_o"), *(F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in values))
    inside = Window.partitionBy(group, "_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(offsets), [group, "_part"], "left")
    made = {name: (F.row_number().over(inside) + F.coalesce("_o", F.lit(0))).cast("long")}
    made |= {n: F.sum(f"_v_{n}").over(upto) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n in values}
    return joined.withColumns(made).drop("_part", "_o", *(f"_o_{n}" for n in values), *(f"_v_{n}" for n in values))


def neighbours_in_place(placed: DataFrame, group: str, columns: list[str], most: int, place: str = "place") -> DataFrame:
    """group, a, b: ``columns`` of each row and of the next of its group by ``place``; most: ``largest`` of the groups."""
    side = placed.select(group, place, F.struct(*columns).alias("a"))
    if most <= WHOLE:
        return side.withColumn("b", F.lead("a").over(Window.partitionBy(group).orderBy(place))).filter("b is not null").select(group, "a", "b")
    return side.join(side.select(group, (F.col(place) - 1).alias(place), F.col("a").alias("b")), [group, place]).select(group, "a", "b")


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 8, less the factors between."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5))
    return series - sum((F.log(x + k) for k in range(8)), F.lit(0.0))
