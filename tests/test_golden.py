"""Values fixed by the blueprint's fixtures."""

from pyspark.sql import functions as F

from panelweave.functions.columns import balanced_group, content_hash, page_identity
from panelweave.operators import learning, sequence, tasks


def sizes(spark, n, most=12):
    rows = spark.range(n).select(balanced_group(F.col("id"), F.lit(n), most).alias("g")).groupBy("g").count().orderBy("g").collect()
    return [r["count"] for r in rows]


def test_batch_sizes(spark):
    assert sizes(spark, 3) == [3]
    assert sizes(spark, 13) == [7, 6]
    assert sizes(spark, 15) == [8, 7]
    assert sizes(spark, 300) == [12] * 25


def test_page_identity(spark):
    df = spark.createDataFrame([("252（1）.jpg",), ("252-1.jpg",), (None,), ("A12.JPEG ",)], "name string")
    assert [r[0] for r in df.select(page_identity(F.col("name"))).collect()] == ["252(1)", None, None, "A12"]


def test_content_hash(spark):
    df = spark.createDataFrame([("字", 1)], "`文` string, a int")
    assert df.select(content_hash("文", "a")).first()[0] == "34c6fc414ec748193fef5f5ac8e503f1876061cbdf575e8ee8f62a805f67f65f"


def test_context_of_batches(spark):
    pages = spark.range(1, 25).select(F.lit("p").alias("project_id"), F.col("id").alias("page_id"))
    rows = sequence.batches(pages).orderBy("batch").collect()
    assert [(r.before, r.after) for r in rows] == [("", "13,14"), ("11,12", "")]


def test_streaks(spark):
    kinds = ["fail", "fail", "complete", "fail", "fail", "fail"]
    events = spark.createDataFrame([(1, i, i, k, 0) for i, k in enumerate(kinds)], "lane long, ts long, event_id long, kind string, code long")
    rows = tasks.failure_streaks(events).orderBy("event_id").collect()
    assert [r.streak for r in rows] == [1, 2, 1, 2, 3] and [r.paused for r in rows] == [False] * 4 + [True]


def test_promotion_needs_two_pages_and_two_clusters(spark):
    rows = [(p, c, "x", "s", True, f"{c}-{p}") for p, c in ((1, 1), (2, 1), (3, 2), (4, 2), (5, 3))]
    df = spark.createDataFrame(rows, "page long, cluster long, character string, signature string, effective boolean, failure_id string")
    assert {r["scope"]: r["count"] for r in learning.promoted(df).groupBy("scope").count().collect()} == {"page": 5, "cluster": 2, "project": 1, "skill_candidate": 1}
