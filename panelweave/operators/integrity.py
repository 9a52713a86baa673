"""Joins between documents of a project that find what is missing, extra, repeated or in conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bijection_faults(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """key, fault: missing (no output), extra (no input) or repeated, with counts on each side."""
    left = inputs.groupBy(key).agg(F.count("*").alias("n_in"))
    right = outputs.groupBy(key).agg(F.count("*").alias("n_out"))
    both = left.join(right, key, "full_outer").select(key, F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))
    fault = F.when(F.col("n_out") == 0, "missing").when(F.col("n_in") == 0, "extra").when((F.col("n_in") > 1) | (F.col("n_out") > 1), "repeated")
    return both.withColumn("fault", fault).filter("fault is not null")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def resolved(facts: DataFrame) -> DataFrame:
    """subject, value, priority -> the value of the best priority; conflict where that rank has several values."""
    best = Window.partitionBy("subject").orderBy("priority")
    top = facts.withColumn("rank", F.rank().over(best)).filter("rank = 1")
    return top.groupBy("subject").agg(F.min("priority").alias("priority"), F.countDistinct("value").alias("values"), F.min("value").alias("value")).withColumn("conflict", F.col("values") > 1)


def self_reviews(made: DataFrame, reviewed: DataFrame) -> DataFrame:
    """unit rows whose reviewer is among the generators: made (unit, generator), reviewed (unit, reviewer)."""
    return reviewed.join(made.distinct(), (reviewed["unit"] == made["unit"]) & (reviewed["reviewer"] == made["generator"]), "left_semi")
