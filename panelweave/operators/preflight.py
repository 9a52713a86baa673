"""Candidate checks against originals, independent reviews, and what is eligible in the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The checks in order, and the default thresholds.
CHECKS = ("decodable", "dimensions", "blank_page", "edge_density_delta", "rgb_mean_delta", "rgb_std_delta", "text_policy")
THRESHOLDS = {"min_grayscale_variance": 20.0, "max_edge_density_delta": 0.12, "max_rgb_mean_delta": 20.0, "max_rgb_std_delta": 15.0}


def _graded(value: Column, good: Column) -> Column:
    return F.when(value.isNull(), "blocked").when(good, "pass").otherwise("fail")


def unlisted(detected: Column, allowed: Column) -> Column:
    """Art texts that the allow-list lacks."""
    return F.array_except(F.coalesce(detected, F.array().cast("array<string>")), F.coalesce(allowed, F.array().cast("array<string>")))


def overall(checks: Column) -> Column:
    """fail before blocked before pass over structs with a status."""
    some = lambda status: F.exists(checks, lambda c: c["status"] == status)
    return F.when(some("fail"), "fail").when(some("blocked"), "blocked").otherwise("pass")


def preflight(pairs: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Adds checks (name, status) and status.

    pairs: candidate_ok, original_ok, same_size, variance, edge_delta, mean_delta, std_delta
    (null where a side could not be decoded), policy, and ocr_ok (null without OCR data).
    """
    limit = THRESHOLDS | (thresholds or {})
    below = lambda name, column: _graded(F.col(column), F.col(column) <= limit[name])
    text = F.when(F.col("policy") != "textless", "not_applicable").otherwise(_graded(F.col("ocr_ok"), F.col("ocr_ok")))
    seen = lambda column, good: F.when(~F.col("candidate_ok"), "blocked").otherwise(_graded(F.col(column), good))
    statuses = (
        F.when(F.col("candidate_ok") & F.col("original_ok"), "pass").otherwise("fail"), seen("same_size", F.col("same_size")), seen("variance", F.col("variance") >= limit["min_grayscale_variance"]),
        below("max_edge_density_delta", "edge_delta"), below("max_rgb_mean_delta", "mean_delta"), below("max_rgb_std_delta", "std_delta"), text,
    )
    checks = F.array(*(F.struct(F.lit(name).alias("name"), status.alias("status")) for name, status in zip(CHECKS, statuses)))
    return pairs.withColumn("checks", checks).withColumn("status", overall(F.col("checks")))


def vector_metrics(v: Column, edge: float) -> Column:
    """Mean, population deviation and edge density of one row of values on the 0 to 255 scale."""
    n = F.size(v)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(v) / n
    spread = total(F.transform(v, lambda x: x * x)) / n - mean * mean
    jumps = F.zip_with(F.slice(v, 2, F.greatest(n - 1, F.lit(0))), F.slice(v, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    return F.struct(mean.alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std"), spread.alias("variance"), (F.size(F.filter(jumps, lambda x: x > edge)) / F.greatest(n - 1, F.lit(1))).alias("edges"))


def review_faults(reviews: DataFrame) -> DataFrame:
    """Reviews joined to their preflight that may not stand: unknown preflight, other hash, author as reviewer, or accepted without a pass."""
    known = F.col("preflight_hash").isNotNull()
    rules = {
        "preflight_unknown": ~known, "candidate_hash_differs": known & ~F.col("candidate_hash").eqNullSafe(F.col("preflight_hash")),
        "reviewer_is_author": F.lower("reviewer") == F.lower("author"), "accepted_without_pass": (F.col("decision") == "accepted") & ~F.col("status").eqNullSafe(F.lit("pass")),
    }
    found = F.array_compact(F.array(*(F.when(fault, F.lit(name)) for name, fault in rules.items())))
    return reviews.select("review_id", F.explode(found).alias("fault"))


def finally_eligible(preflights: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Candidates whose preflight passed and whose independent review accepted."""
    return preflights.filter("status = 'pass'").join(reviews.filter("decision = 'accepted'").select(key).distinct(), key, "left_semi").select(key)
