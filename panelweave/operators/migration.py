"""The migration plan: pages to clusters, classes and tasks, candidates bound to pages, blockers and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import balanced_group, content_hash
from panelweave.functions.text import nfkc, trimmed
from panelweave.operators.rules import with_task_class
from panelweave.operators.sequence import BATCH, placed

#: The action of each page class.
ACTIONS = {"unchanged": "unchanged", "text_only": "text_only", "full_page_redraw": "full_page_regeneration", "evidence_blocked": "evidence_blocked"}


def alignment_state(status: Column) -> Column:
    said = F.lower(F.trim(status))
    return F.when(said.isin("confirmed", "provisional"), said).otherwise("unresolved")


#: Patterns of candidate names: what follows the page, a page and its variant, a leading page.
TAIL, VARIANT, LEADING = "(?i)_(repaired|candidate|visual).*$", r"^(\d+)_(\d+)(_|$)", r"^(\d+(\(\d+\))?)"
PAGES = 9_999


def candidate_page(name: Column) -> Column:
    """The page that a file or folder name speaks of, in NFKC: suffixes such as _repaired off, 12_1 as 12(1), else the leading number, else the name."""
    bare = F.regexp_replace(trimmed(nfkc(name)), TAIL, "")
    variant, number = F.regexp_extract(bare, VARIANT, 1), F.regexp_extract(bare, LEADING, 1)
    return F.when(variant != "", F.concat(variant, F.lit("("), F.regexp_extract(bare, VARIANT, 2), F.lit(")"))).when(number != "", number).otherwise(bare)


def page_in_range(name: Column, most: int = PAGES) -> Column:
    """Whether a page number with an optional variant lies in 1 to `most`; numbers may have any number of digits, and other names have no number."""
    digits = F.regexp_replace(F.regexp_extract(name, r"^([0-9]+)(\([0-9]+\))?$", 1), "^0+", "")
    return (digits != "") & (F.length(digits) <= len(str(most))) & (F.substring(digits, 1, len(str(most))).try_cast("int") <= most)


def bound_candidates(candidates: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """project_id, key and page: the nearest name on the path, from the file upward, that is a page of the project; null where none is. candidates: project_id, key, path. pages: project_id, page."""
    parts = F.reverse(F.filter(F.split("path", "/"), lambda x: x != ""))
    stems = F.transform(parts, lambda x, i: F.when(i == 0, F.regexp_replace(x, r"\.[^.]*$", "")).otherwise(x))
    named = candidates.select("project_id", key, F.posexplode(stems).alias("depth", "name")).withColumn("page", candidate_page(F.col("name")))
    met = named.join(pages.select("project_id", "page").distinct(), ["project_id", "page"]).groupBy("project_id", key).agg(F.min_by("page", "depth").alias("page"))
    return candidates.select("project_id", key).join(met, ["project_id", key], "left")


def planned_tasks(pages: DataFrame, most: int = BATCH) -> DataFrame:
    """One task a page: cluster, class, action, payload hash and id; the canary of a cluster first. pages: project_id, page_id, risk, unresolved, action."""
    placed_pages = placed(pages).withColumn("cluster", balanced_group(F.col("pos"), F.col("total"), most))
    group = Window.partitionBy("project_id", "cluster").orderBy("pos")
    middle = F.floor((F.count("*").over(Window.partitionBy("project_id", "cluster")) - 1) / 2)
    told = with_task_class(placed_pages).withColumn("is_canary", F.row_number().over(group) - 1 == middle)
    actions = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    told = told.withColumn("planned_action", actions[F.col("page_class")]).withColumn("payload_hash", content_hash("cluster", "page_class", "page_id", "project_id"))
    order = Window.partitionBy("project_id").orderBy(F.desc("is_canary"), "cluster", "pos")
    return told.withColumn("task_id", content_hash("page_id", "payload_hash", "task_type")).withColumn("task_order", F.row_number().over(order).cast("bigint"))


def plan_summary(tasks: DataFrame) -> DataFrame:
    """By project: pages, clusters, tasks by class, unresolved pages, and whether it is ready (nothing blocked)."""
    told = tasks.groupBy("project_id").agg(F.count("*").alias("pages"), F.countDistinct("cluster").alias("clusters"), F.count_if("unresolved").alias("unresolved"), *(F.count_if(F.col("page_class") == c).alias(f"n_{c}") for c in ACTIONS))
    return told.withColumn("ready", F.col("n_evidence_blocked") == 0)


def page_lists(pages: DataFrame) -> DataFrame:
    """By project: its unresolved and its unconfirmed pages, in order. pages: project_id, page_id, state."""
    listed = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("page_id"))))
    return pages.groupBy("project_id").agg(F.count("*").alias("pages"), listed(F.col("state") == "unresolved").alias("unresolved_pages"), listed(F.col("state") != "confirmed").alias("unconfirmed_pages"))


def membership_faults(clusters: DataFrame, pages: DataFrame) -> DataFrame:
    """project_id and fault where the members of all clusters, in cluster order, are not the pages in story order. clusters: project_id, cluster, place, page_id. pages: project_id, page_id, pos."""
    order = Window.partitionBy("project_id").orderBy("cluster", "place")
    walked = clusters.withColumn("at", F.row_number().over(order) - 1)
    counted = walked.join(pages, ["project_id", "page_id"], "full_outer").groupBy("project_id").agg(F.count_if(F.col("at").isNull()).alias("uncovered"), F.count_if(F.col("pos").isNull()).alias("unknown"), F.count_if(F.col("at") != F.col("pos")).alias("out_of_order"))
    return counted.filter("uncovered + unknown + out_of_order > 0")
