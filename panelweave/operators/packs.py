"""Reference packs of page clusters: which references, their content ids, and packs that break the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import balanced_group
from panelweave.functions.text import contaminated
from panelweave.operators.sequence import BATCH, placed


def dealt_clusters(pages: DataFrame, most: int = BATCH) -> DataFrame:
    """Pages with pos and cluster_id, in balanced groups of the story."""
    group = balanced_group(F.col("pos"), F.col("total"), most)
    return placed(pages).withColumn("cluster_id", F.concat_ws("#", F.coalesce("project_id", F.lit("")), group))


def references(pages: DataFrame) -> DataFrame:
    """project_id, cluster_id, path, role: the canary as primary style, the two pages on either side as adjacent style, and an identity sheet for each of the project's locations.

    A page is context of a cluster if one of the two pages after or before it is in it.
    """
    order = Window.partitionBy("project_id").orderBy("pos")
    path = lambda page: F.concat(F.lit("pages/"), page.cast("string"), F.lit(".jpg"))
    canary = F.max_by("page_id", F.struct(F.coalesce("risk", F.lit(-1)), -F.col("pos")))
    primary = pages.groupBy("project_id", "cluster_id").agg(canary.alias("page_id")).select("project_id", "cluster_id", path(F.col("page_id")).alias("path"), F.lit("primary_style").alias("role"))
    near = F.array_distinct(F.array_compact(F.array(*(step("cluster_id", n).over(order) for step in (F.lag, F.lead) for n in (1, 2)))))
    beside = pages.withColumn("near", F.array_remove(near, F.col("cluster_id"))).select("project_id", F.explode("near").alias("cluster_id"), path(F.col("page_id")).alias("path"), F.lit("adjacent_style").alias("role"))
    sheets = pages.filter(F.col("location").isNotNull()).select("project_id", "location").distinct()
    each = pages.select("project_id", "cluster_id").distinct()
    identity = each.join(sheets, each["project_id"].eqNullSafe(sheets["project_id"])).select(each["project_id"], "cluster_id", F.concat(F.lit("identity/"), F.lower("location"), F.lit(".png")).alias("path"), F.lit("identity_only").alias("role"))
    return primary.unionAll(beside).unionAll(identity)


def packs(refs: DataFrame) -> DataFrame:
    """cluster_id, references and the pack's content id over its cluster and references by path and role, and its binding hash."""
    made = refs.groupBy("cluster_id").agg(F.array_sort(F.collect_set(F.struct("path", "role"))).alias("references"))
    made = made.withColumn("reference_pack_id", F.sha2(F.to_json(F.struct("cluster_id", "references")), 256))
    bound = F.sha2(F.to_json(F.struct("reference_pack_id", "references")), 256)
    return made.select("cluster_id", F.size("references").cast("bigint").alias("n_references"), "reference_pack_id", bound.alias("binding_hash"))


def pack_faults(refs: DataFrame) -> DataFrame:
    """cluster_id and fault of packs without exactly one primary and at least one adjacent style, or with a contaminated style."""
    style = F.col("role").isin("primary_style", "adjacent_style")
    told = refs.groupBy("cluster_id").agg(F.count_if(F.col("role") == "primary_style").alias("primaries"), F.count_if(F.col("role") == "adjacent_style").alias("adjacent"), F.max(style & contaminated(F.col("path"))).alias("bad"))
    faults = F.array_compact(F.array(F.when(F.col("primaries") != 1, "primary_style_not_one"), F.when(F.col("adjacent") == 0, "adjacent_style_missing"), F.when(F.col("bad"), "style_contaminated")))
    return told.select("cluster_id", F.explode(faults).alias("fault"))


def binding_conflicts(bindings: DataFrame) -> DataFrame:
    """Clusters that were bound to more than one pack; bindings are (cluster_id, reference_pack_id)."""
    return bindings.groupBy("cluster_id").agg(F.countDistinct("reference_pack_id").alias("packs")).filter("packs > 1")
