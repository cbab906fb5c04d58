"""Columnar files and metastore tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_columns(spark: SparkSession, path: str, columns: list[str], form: str = "orc") -> DataFrame:
    """The named columns of ORC (or other columnar) files; the scan reads no others."""
    return spark.read.format(form).load(path).select(*columns)


def write_columns(df: DataFrame, path: str, form: str = "orc", mode: str = "errorifexists") -> None:
    df.write.format(form).mode(mode).save(path)


def read_table(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    table = spark.table(name)
    return table.select(*columns) if columns else table


def save_table(df: DataFrame, name: str, form: str = "parquet", append: bool = False) -> None:
    """Create (or replace) a metastore table, or insert into one by column name."""
    if append and df.sparkSession.catalog.tableExists(name):
        df.select(*df.sparkSession.table(name).columns).write.insertInto(name)
    else:
        df.write.format(form).mode("overwrite").saveAsTable(name)


def numbered(edges: DataFrame, src: str, dst: str) -> tuple[DataFrame, DataFrame]:
    """Edges of string ids as src, dst of long ids, and the table (id, name) of the numbers.

    Numbers are distinct and hold from 0 on by partition, not without gaps, so that no task sees all names.
    """
    from pyspark.sql import functions as F

    from tessera.functions.storage import cut

    names = edges.select(F.col(src).cast("string").alias("name")).union(edges.select(F.col(dst).cast("string").alias("name"))).filter("name is not null").distinct()
    ids = cut(names.withColumn("id", F.monotonically_increasing_id()).select("id", "name"))
    left, right = ids.select(F.col("id").alias("src"), F.col("name").alias("_a")), ids.select(F.col("id").alias("dst"), F.col("name").alias("_b"))
    rest = [F.col(c) for c in edges.columns if c not in (src, dst)]
    return edges.join(left, F.col(src).cast("string") == F.col("_a")).join(right, F.col(dst).cast("string") == F.col("_b")).select("src", "dst", *rest), ids
