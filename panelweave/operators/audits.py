"""Audits of the learning store: failure records, outcomes, promotion chains, their events, and rules in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The taxonomy of failure codes, by code point.
CODES = ("anatomy_error", "composition_drift", "costume_prop_drift", "identity_drift", "over_rendering", "scene_drift", "style_drift", "text_leak")


def sorted_codes(codes: Column) -> Column:
    """Trimmed codes, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(codes, lambda c: F.trim(c))))


def unknown_codes(codes: Column) -> Column:
    return F.array_except(codes, F.array(*map(F.lit, CODES)))


def record_conflicts(records: DataFrame, key: str, *body: str) -> DataFrame:
    """Records that were given under one id with different bodies: key, copies and bodies."""
    spelled = F.to_json(F.struct(*sorted(body)), {"ignoreNullFields": "false"})
    return records.groupBy(key).agg(F.count("*").alias("copies"), F.countDistinct(spelled).alias("bodies")).filter("bodies > 1")


def outcome_states(failures: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Each failure with its outcome, which is written once and must change the candidate: observed, reviewed, conflict or unchanged. failures have before; outcomes have after."""
    seen = outcomes.groupBy(key).agg(F.countDistinct("after").alias("outcomes"), F.min("after").alias("after"))
    state = F.when(F.coalesce("outcomes", F.lit(0)) == 0, "observed").when(F.col("outcomes") > 1, "conflict").when(F.col("after") == F.col("before"), "unchanged").otherwise("reviewed")
    return failures.join(seen, key, "left").select(key, state.alias("state"))


def chain_faults(rules: DataFrame, sources: DataFrame, least: int = 2) -> DataFrame:
    """rule_id and fault of rules whose sources differ in signature, are fewer places than needed, or are revoked while the rule is active.

    rules: rule_id, signature, active. sources: rule_id, signature, place, revoked.
    """
    told = sources.withColumnRenamed("signature", "of_source").join(rules.select("rule_id", "signature"), "rule_id")
    seen = told.groupBy("rule_id").agg(F.countDistinct("place").alias("places"), F.max(~F.col("of_source").eqNullSafe(F.col("signature"))).alias("differs"), F.max("revoked").alias("fallen"))
    joined = rules.join(seen, "rule_id", "left")
    faults = F.array(F.when(F.coalesce("places", F.lit(0)) < least, "too_few_sources"), F.when(F.col("differs"), "signature_differs"), F.when(F.col("fallen") & F.col("active"), "active_on_revoked_source"))
    return joined.select("rule_id", F.explode(F.array_compact(faults)).alias("fault"))


def event_faults(rules: DataFrame, events: DataFrame) -> DataFrame:
    """Rules without exactly one promotion event, or whose revocation events do not match their state. rules: rule_id, revoked. events: rule_id, event_type."""
    counted = events.groupBy("rule_id").agg(F.count_if(F.col("event_type") == "promotion").alias("promotions"), F.count_if(F.col("event_type") == "revocation").alias("revocations"))
    both = rules.join(counted, "rule_id", "left").select("rule_id", "revoked", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("promotions", "revocations")))
    return both.filter((F.col("promotions") != 1) | (F.col("revocations") != F.col("revoked").cast("int"))).select("rule_id", "promotions", "revocations")


def revoked_in_use(uses: DataFrame, rules: DataFrame) -> DataFrame:
    """(page, rule_id) of pages that name a revoked rule."""
    return uses.select("page", "rule_id").distinct().join(rules.filter("revoked").select("rule_id"), "rule_id", "left_semi").select("page", "rule_id")


def regression_gate(corpus: DataFrame) -> DataFrame:
    """By signature: corpus rows, failing rows, and whether broad promotion may go on. corpus: signature, failing."""
    return corpus.groupBy("signature").agg(F.count("*").alias("rows"), F.count_if("failing").alias("failing")).withColumn("promotable", F.col("failing") == 0)


def failure_faults(failures: DataFrame) -> DataFrame:
    """(failure_id, fault) of records that break their status: observed with an outcome, reviewed without one or with an unchanged candidate, or codes not known, sorted and unique.

    failures: failure_id, codes, status, before, after, reviewer.
    """
    seen, done = F.col("status") == "observed", F.col("status") == "reviewed"
    rules = {
        "codes_unknown": F.size(unknown_codes(F.col("codes"))) > 0, "codes_not_canonical": ~F.col("codes").eqNullSafe(sorted_codes(F.col("codes"))), "codes_empty": F.coalesce(F.size("codes"), F.lit(0)) < 1,
        "observed_with_outcome": seen & (F.col("after").isNotNull() | F.col("reviewer").isNotNull()), "reviewed_without_outcome": done & (F.col("after").isNull() | F.col("reviewer").isNull()), "candidate_unchanged": done & (F.col("after") == F.col("before")), "status_value": ~(seen | done),
    }
    return failures.select("failure_id", F.explode(F.array_compact(F.array(*(F.when(fault, F.lit(name)) for name, fault in rules.items())))).alias("fault"))
