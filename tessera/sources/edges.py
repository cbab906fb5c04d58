"""Readers and writers of the text forms that graphs, points and sequences come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edges(spark: SparkSession, path: str, sep: str = r"[\s,]+", weighted: bool = False, loops: bool = True) -> DataFrame:
    """src, dst[, weight]: lines of two or three fields; those that start with # or % or are shorter are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter(~F.col("v").rlike("^[#%]") & (F.col("v") != ""))
    parts = lines.select(F.split("v", sep).alias("p")).filter(F.size("p") >= 2)
    columns = [F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst")]
    columns += [F.coalesce(F.get("p", F.lit(2)).cast("double"), F.lit(1.0)).alias("weight")] * weighted
    out = parts.select(*columns)
    return out if loops else out.filter("src <> dst")


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """id, community from lines such as ``(1,7)``."""
    parts = spark.read.text(path).select(F.split(F.regexp_replace("value", r"[()\s]+", " "), "[ ,]+").alias("p"))
    return parts.select(F.filter("p", lambda x: x != "").alias("p")).filter(F.size("p") >= 2).select(F.col("p")[0].cast("long").alias("id"), F.col("p")[1].cast("long").alias("community"))


def read_values(spark: SparkSession, path: str, sep: str = r"[\s,]+") -> DataFrame:
    """id, value from lines of a vertex and a number; comments and shorter lines are left out."""
    parts = spark.read.text(path).select(F.trim("value").alias("v")).filter(~F.col("v").rlike("^[#%]")).select(F.split("v", sep).alias("p")).filter(F.size("p") >= 2)
    return parts.select(F.col("p")[0].cast("long").alias("id"), F.col("p")[1].cast("double").alias("value"))


def read_ids(spark: SparkSession, path: str, sep: str = r"[\s,]+") -> DataFrame:
    """id: the first field of each line, as in lists of sources or of the best vertices."""
    return spark.read.text(path).select(F.split(F.trim("value"), sep)[0].alias("v")).filter(F.col("v").rlike(r"^-?\d+$")).select(F.col("v").cast("long").alias("id"))


def read_labelled(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    """label, features (vector) from lines ``label index:value ...`` with indexes from 1."""
    reader = spark.read.format("libsvm")
    return (reader if features is None else reader.option("numFeatures", features)).load(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """id, vec from lines ``id<tab>v,v,...`` or ``id (v,v,...)``."""
    got = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\d+)", 1).cast("long").alias("id"), F.regexp_extract("value", r"^\s*\d+[\s(]+([^)]*)", 1).alias("v"))
    return got.select("id", F.transform(F.split("v", r"\s*[,\s]\s*"), lambda x: x.cast("double")).alias("vec"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """sequence: array of item sets from lines of numbers in which -1 ends a set and -2 the sequence."""
    body = F.regexp_replace("value", r"\s*-2\s*$", "")
    sets = F.filter(F.split(body, r"\s*-1\s*"), lambda s: F.trim(s) != "")
    return spark.read.text(path).select(F.transform(sets, lambda s: F.transform(F.split(F.trim(s), r"\s+"), lambda x: x.cast("int"))).alias("sequence"))


def read_libfm(spark: SparkSession, path: str) -> DataFrame:
    """label, field, feature, value: the long form of ``label field:feature:value ...`` lines."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).select(F.col("p")[0].cast("double").alias("label"), F.explode(F.slice("p", 2, F.size("p"))).alias("x"))
    x = F.split("x", ":")
    return parts.select("label", x[0].cast("int").alias("field"), x[1].cast("int").alias("feature"), x[2].cast("double").alias("value"))


def adjacency(edges: DataFrame) -> DataFrame:
    """src, pr, dsts: one row a vertex with out-edges."""
    return edges.groupBy("src").agg(F.lit(1.0).alias("pr"), F.sort_array(F.collect_list("dst")).alias("dsts"))


def write_pairs(df: DataFrame, path: str, sep: str = ",") -> None:
    """The columns of each row as a line of text."""
    df.select(F.concat_ws(sep, *(F.col(c).cast("string") for c in df.columns)).alias("value")).write.text(path)
