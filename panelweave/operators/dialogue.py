"""Dialogue blocks of pages: spans in the source, owners and density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import visible_characters

BUDGET = 25


def spans(blocks: DataFrame) -> DataFrame:
    """page, block, text -> start and end of each block in the page's texts joined by newlines, in block order."""
    ahead = Window.partitionBy("page").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(ahead), F.lit(0)).cast("bigint")
    return blocks.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def _in_order() -> Column:
    return F.array_sort(F.collect_list(F.struct("block", "speaker", "text")))


def slice_checks(blocks: DataFrame) -> DataFrame:
    """By page: blocks, length of the source, slices of the source equal to their block, and spans that start before the last one ends."""
    told = blocks.withColumn("text", F.coalesce("text", F.lit("")))
    order = Window.partitionBy("page").orderBy("block", "speaker", "text")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = told.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(ahead), F.lit(0))).withColumn("end", F.col("start") + F.length("text")).withColumn("past", F.lag("end").over(order))
    source = told.groupBy("page").agg(F.array_join(F.transform(_in_order(), lambda x: x["text"]), "\n").alias("source"))
    cut = F.substring(F.col("source"), F.col("start") + 1, F.length("text"))
    return placed.join(source, "page").groupBy("page").agg(F.count("*").alias("blocks"), F.max(F.length("source")).cast("bigint").alias("length"), F.count_if(cut == F.col("text")).alias("equal"), F.count_if(F.col("start") < F.col("past")).alias("overlaps"))


def text_requests(blocks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One text-repair request a page: its blocks in order, a hash of the text, and whether a block needs a reason to exceed the budget."""
    told = blocks.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("speaker", F.coalesce("speaker", F.lit("")))
    lines = F.transform(_in_order(), lambda x: F.concat(F.lit("["), x["block"].cast("string"), F.lit("] "), x["speaker"], F.lit(": "), x["text"]))
    made = told.groupBy("page").agg(F.array_join(lines, "\n").alias("request"), F.max(visible_characters(F.col("text")) > budget).alias("needs_reason"))
    return made.select("page", F.length("request").cast("bigint").alias("length"), F.sha2("request", 256).alias("request_hash"), "needs_reason")


def density(blocks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """By page: blocks, visible characters, blocks over the budget, and speakers."""
    seen = visible_characters(F.col("text"))
    return blocks.groupBy("page").agg(F.count("*").alias("blocks"), F.sum(seen).alias("visible"), F.count_if(seen > budget).alias("over_budget"), F.countDistinct("speaker").alias("speakers"))


def unowned(blocks: DataFrame) -> DataFrame:
    """Balloons without exactly one speaker."""
    return blocks.groupBy("page", "block").agg(F.countDistinct("speaker").alias("owners")).filter("owners <> 1")
