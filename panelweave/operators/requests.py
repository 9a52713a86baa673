"""Redraw requests: one text a page from its facts, references, locks and rules, their fingerprints, and specs that may not be compiled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The version that a request opens with, and the size of a page.
VERSION = "redraw-request/1"
SIZE = (896, 1200)


def section(rows: DataFrame, page: str, *fields: str) -> DataFrame:
    """page and a JSON list of the fields in their order, so that data stays data inside a request."""
    return rows.groupBy(page).agg(F.to_json(F.array_sort(F.collect_set(F.struct(*fields)))).alias("body"))


def redraw_requests(pages: DataFrame, parts: dict[str, DataFrame], page: str) -> DataFrame:
    """page, request and fingerprint: a heading and a JSON list for every section, empty lists where a page has nothing."""
    made = pages.select(page).distinct()
    for name, rows in parts.items():
        made = made.join(rows.withColumnRenamed("body", name), page, "left")
    lines = [F.concat(F.lit(f"## {name}\n"), F.coalesce(F.col(name), F.lit("[]"))) for name in parts]
    told = made.select(page, F.concat_ws("\n", F.lit(VERSION), *lines).alias("request"))
    return told.withColumn("fingerprint", fingerprint(F.col("request")))


def fingerprint(request: Column) -> Column:
    """Hash of version and text together; null where the text does not open with the version."""
    return F.when(F.startswith(request, F.lit(VERSION + "\n")), F.sha2(F.to_json(F.struct(request.alias("text"), F.lit(VERSION).alias("version"))), 256))


def block_faults(blocks: DataFrame, budget: int = 25) -> DataFrame:
    """(page, fault) of pages whose balloons repeat, or with a block over the budget without a reason. blocks: page, block, text, reason."""
    each = blocks.groupBy("page", "block").agg(F.count("*").alias("n"), F.max((F.length(F.regexp_replace("text", r"(?U)\s", "")) > budget) & (F.coalesce("reason", F.lit("")) == "")).alias("over"))
    told = each.groupBy("page").agg(F.max(F.col("n") > 1).alias("repeats"), F.max("over").alias("over"))
    return told.select("page", F.explode(F.array_compact(F.array(F.when(F.col("repeats"), "balloon_repeated"), F.when(F.col("over"), "over_budget_without_reason")))).alias("fault"))


def rule_context_faults(uses: DataFrame) -> DataFrame:
    """Uses of rules outside their scope. uses: page, cluster, character, scope, rule_page, rule_cluster, rule_character."""
    wrong = F.when(F.col("scope") == "page", ~F.col("rule_page").eqNullSafe(F.col("page"))).when(F.col("scope") == "cluster", ~F.col("rule_cluster").eqNullSafe(F.col("cluster"))).otherwise(F.col("rule_page").isNotNull() | F.col("rule_cluster").isNotNull())
    other = F.col("rule_character").isNotNull() & ~F.col("rule_character").eqNullSafe(F.col("character"))
    return uses.withColumn("fault", F.when(wrong, "scope_differs").when(other, "character_differs")).filter("fault is not null")


def size_faults(specs: DataFrame, *keys: str) -> DataFrame:
    """Specs whose output size, the fixed one where absent, is another."""
    width, height = (F.coalesce(c, F.lit(d)) for c, d in zip(("width", "height"), SIZE))
    return specs.filter((width != SIZE[0]) | (height != SIZE[1])).select(*keys)
