"""Reading tables of a data folder, and the views of them that the queries use as projects, lanes and packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def story_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages in story order: a project is a source and a block of 500 ids, so projects grow in number and not in size."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), F.floor(F.col("doc_id") / 500)).alias("project_id"), F.col("doc_id").alias("page_id"), F.col("source").alias("chapter"), F.col("lang").alias("location"),
        F.when(F.col("n_chars") < 1000, "day").otherwise("night").alias("story_time"), (F.col("doc_id") % 3).cast("string").alias("scene_id"), F.col("n_chars").alias("risk"),
    )


def evidence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages of finished projects: a project is a source and a block of 500 ids, pos the place from 1 and n the number of pages in it."""
    pages = table(spark, sf_dir, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), F.floor(F.col("doc_id") / 500)).alias("project_id"), "doc_id", "lang", "n_chars", "text")
    whole = Window.partitionBy("project_id")
    return pages.withColumn("pos", F.row_number().over(whole.orderBy("doc_id"))).withColumn("n", F.count("*").over(whole))


def url_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as page files: a project is a host, a file name the last part of the path."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("project_id"), F.regexp_extract("url", "([^/]*)$", 1).alias("name"))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as task events: a lane is a user, ordered by time and id; a project is ten users."""
    kinds = F.create_map(*(F.lit(x) for pair in (("signup", "add"), ("view", "claim"), ("purchase", "complete"), ("error", "fail"), ("click", "reopen")) for x in pair))
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 10).alias("project_id"), F.col("user_id").alias("lane"), "event_id", "ts", kinds[F.col("event_type")].alias("kind"), (k % 2).alias("code"), (k % 7).alias("prompt"), k.alias("cache_key"), "value")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as failed attempts; those that helped are effective."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("cluster"), F.col("l_linestatus").alias("character"), F.col("l_returnflag").alias("signature"), ((F.col("l_quantity") > 48) & (F.col("l_discount") >= 0.09)).alias("effective"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("failure_id"))
