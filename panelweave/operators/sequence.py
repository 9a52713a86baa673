"""Order, batches, scene runs and clusters of the pages of many projects.

The project is the partition key of every window. A project has at most 9,999 pages, so
windows are bounded and scale comes from the number of projects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import balanced_group, natural_key, page_key

BATCH = 12
RADIUS = 2
CHUNK = 20


def story_index(pages: DataFrame) -> DataFrame:
    """project_id, page_id, name -> with index and output name, in natural order."""
    order = Window.partitionBy("project_id").orderBy(natural_key(F.col("name")), "name", "page_id")
    return pages.withColumn("index", F.row_number().over(order).cast("bigint")).withColumn("output_name", F.format_string("%04d.jpg", "index"))


def repeated_pages(pages: DataFrame) -> DataFrame:
    """project_id, page_id, name and copies of page files that are one page with another file of their project."""
    same = pages.withColumn("key", page_key(F.col("name")))
    return same.withColumn("copies", F.count("*").over(Window.partitionBy("project_id", "key"))).filter("copies > 1").select("project_id", "page_id", "name", "copies")


def placed(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """Adds pos (from 0) and total in the project."""
    whole = Window.partitionBy("project_id")
    return pages.withColumn("pos", F.row_number().over(whole.orderBy(order)) - 1).withColumn("total", F.count("*").over(whole))


def with_context(pages: DataFrame, group: str, radius: int = RADIUS) -> DataFrame:
    """One row a group: members, and the ids just before its first and after its last member, comma-joined."""
    order = Window.partitionBy("project_id").orderBy("pos")
    around = pages.withColumn("pre", F.collect_list("page_id").over(order.rowsBetween(-radius, -1))).withColumn("post", F.collect_list("page_id").over(order.rowsBetween(1, radius)))
    made = around.groupBy("project_id", group).agg(F.array_sort(F.collect_list(F.struct("pos", "page_id"))).alias("m"), F.min_by("pre", "pos").alias("pre"), F.max_by("post", "pos").alias("post"))
    spelled = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return made.select("project_id", group, F.size("m").cast("bigint").alias("size"), spelled(F.col("m.page_id")).alias("members"), spelled(F.col("pre")).alias("before"), spelled(F.col("post")).alias("after"))


def batches(pages: DataFrame, most: int = BATCH) -> DataFrame:
    """Balanced batches with boundary context and a content id."""
    dealt = placed(pages).withColumn("batch", balanced_group(F.col("pos"), F.col("total"), most))
    return with_context(dealt, "batch").withColumn("batch_id", F.sha2(F.concat_ws("|", "project_id", "members"), 256))


def scene_runs(pages: DataFrame) -> DataFrame:
    """Adds run: the number of the maximal stretch of pages with one scene key."""
    order = Window.partitionBy("project_id").orderBy("pos")
    key = F.concat_ws("\x1f", "chapter", "location", "story_time", "scene_id")
    return placed(pages).withColumn("key", key).withColumn("turn", (~F.col("key").eqNullSafe(F.lag("key").over(order))).cast("int")).withColumn("run", F.sum("turn").over(order)).drop("turn")


def scene_chunks(pages: DataFrame, most: int = CHUNK) -> DataFrame:
    """One row a chunk of a run: its size, first page and canary (highest risk, ties by story order)."""
    run = Window.partitionBy("project_id", "run")
    split = scene_runs(pages).withColumn("at", F.row_number().over(run.orderBy("pos")) - 1).withColumn("n", F.count("*").over(run)).withColumn("chunk", balanced_group(F.col("at"), F.col("n"), most))
    return split.groupBy("project_id", "run", "chunk").agg(F.count("*").alias("size"), F.min_by("page_id", "pos").alias("first_page"), F.max_by("page_id", F.struct("risk", -F.col("pos"))).alias("canary"))


def style_neighbours(pages: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pages of a location without another page of it within `radius` positions: their adjacent reference is missing."""
    here = placed(pages).select("project_id", "location", "pos", "page_id")
    around = Window.partitionBy("project_id", "location").orderBy("pos").rangeBetween(-radius, radius)
    return here.withColumn("near", F.count("*").over(around)).filter("near = 1").select("project_id", "page_id", F.col("pos").cast("bigint").alias("pos"))
