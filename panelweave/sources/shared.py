"""Narrow tables that several branches of a plan read: written once in the folder that the cluster shares; and tables dealt alike, so that they meet without another shuffle."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df as a table below spark.checkpoint.dir, so that it is computed once and survives lost executors; a local session without that setting uses a folder of its own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str = "project_id") -> DataFrame:
    """df dealt by key into spark.sql.shuffle.partitions partitions.

    Groupings and windows by the key and more, also of a union of tables that are dealt alike,
    need no other shuffle. The number is fixed, as Spark would merge partitions by the narrow
    bytes that it deals, not by the wide rows that are made of them.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
