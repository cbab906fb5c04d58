"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one only in local mode with the setting unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-tessera-", dir="/tmp")
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a table and read it back, which ends its lineage."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a kept table that a task takes at most, if keys are even.
EACH = 1 << 21


def parts_of(table: DataFrame) -> int:
    """Parts to deal a written table into: as many as the session shuffles into, or more so that a task's share does not grow."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // EACH))
