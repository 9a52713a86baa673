"""Promotion of rules learned from effective repairs, over all that are eligible at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_rules(attempts: DataFrame) -> DataFrame:
    """signature, page, character: its source is the least effective failure, whose cluster it has."""
    return attempts.filter("effective").groupBy("signature", "page", "character").agg(F.min("failure_id").alias("source"), F.min_by("cluster", "failure_id").alias("cluster"))


def cluster_rules(pages: DataFrame, least: int = 2) -> DataFrame:
    return pages.groupBy("signature", "cluster", "character").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= least)


def project_rules(clusters: DataFrame, least: int = 2) -> DataFrame:
    return clusters.groupBy("signature", "character").agg(F.countDistinct("cluster").alias("clusters")).filter(F.col("clusters") >= least)


def revoked(attempts: DataFrame, withdrawn: Column) -> DataFrame:
    """Rules of the ladder that fall when page rules are withdrawn: revocation follows the sources upward."""
    pages = page_rules(attempts).withColumn("revoked", withdrawn)
    clusters = pages.groupBy("signature", "cluster", "character").agg(F.countDistinct("page").alias("n"), F.max("revoked").alias("revoked")).filter("n >= 2")
    projects = clusters.groupBy("signature", "character").agg(F.countDistinct("cluster").alias("n"), F.max("revoked").alias("revoked")).filter("n >= 2")
    row = lambda df, scope, place: df.filter("revoked").select(F.lit(scope).alias("scope"), "signature", "character", place.cast("string").alias("place"))
    none = F.lit(None)
    return row(pages, "page", F.col("page")).unionAll(row(clusters, "cluster", F.col("cluster"))).unionAll(row(projects, "project", none)).unionAll(row(projects, "skill_candidate", none))


def applicable(attempts: DataFrame) -> DataFrame:
    """Attempts that did not help, with how many rules apply to them and the most specific scope.

    Each scope has its own equality keys, so the choice between scopes is a chain of equi-joins.
    """
    asked = attempts.filter("not effective").select("page", "cluster", "character", "signature").distinct()
    pages, clusters = page_rules(attempts), cluster_rules(page_rules(attempts))
    of_page = pages.select("page", "character", "signature", F.lit(1).alias("by_page"))
    of_cluster = clusters.select("cluster", "character", "signature", F.lit(1).alias("by_cluster"))
    of_project = project_rules(clusters).select("character", "signature", F.lit(1).alias("by_project"))
    met = asked.join(of_page, ["page", "character", "signature"], "left").join(of_cluster, ["cluster", "character", "signature"], "left").join(of_project, ["character", "signature"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    scope = F.when(F.col("by_page") == 1, "page").when(F.col("by_cluster") == 1, "cluster").when(F.col("by_project") == 1, "project")
    # a project rule brings its skill candidate along
    return met.select("page", "cluster", "character", "signature", (zero("by_page") + zero("by_cluster") + 2 * zero("by_project")).cast("bigint").alias("rules"), scope.alias("leading"))


def promoted(attempts: DataFrame) -> DataFrame:
    """Every rule of the ladder: scope, signature, character, place (page or cluster) and number of sources."""
    pages = page_rules(attempts)
    clusters = cluster_rules(pages)
    projects = project_rules(clusters)
    row = lambda df, scope, place, n: df.select(F.lit(scope).alias("scope"), "signature", "character", place.cast("string").alias("place"), n.cast("bigint").alias("sources"))
    none = F.lit(None)
    return row(pages, "page", F.col("page"), F.lit(1)).unionAll(row(clusters, "cluster", F.col("cluster"), F.col("pages"))).unionAll(row(projects, "project", none, F.col("clusters"))).unionAll(row(projects, "skill_candidate", none, F.lit(1)))
