"""Row rules: which rule each row breaks, legal combinations, task classes and differences of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The legal repair policies (action, scope, ordinary text, recognition, reset, reason); `any` takes both.
POLICIES = (
    ("unchanged_copy", "unchanged", "any", "not_applicable", "none", "unchanged_page"),
    ("edited", "visual", "true", "reliable", "page", "visual_repair_requires_page_reset"),
    ("edited", "visual", "true", "unreliable", "page", "visual_repair_requires_page_reset"),
    ("edited", "visual", "false", "not_applicable", "none", "no_ordinary_text"),
    ("edited", "text_only", "true", "reliable", "block", "reliable_block_match"),
    ("edited", "text_only", "true", "unreliable", "page", "unreliable_text_page_reset"),
)
#: Spellings of actions, the page class and task type that they stand for.
CLASSES = {
    ("unchanged", "continuity_check"): ("unchanged", "copy_original", "pass_through", "no_change"),
    ("text_only", "text_repair"): ("text_only", "text_repair", "block_replace", "page_reset"),
    ("full_page_redraw", "full_page_redraw"): ("full_page_redraw", "full_page_regeneration", "redraw", "regenerate"),
}
BLOCKED = ("evidence_blocked", "evidence_resolution")


def violations(rows: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """A row (keys, rule_id) for each rule that a row breaks, in one pass over the rows. A rule is the condition of its fault."""
    broken = F.array_compact(F.array(*(F.when(fault, F.lit(name)) for name, fault in rules.items())))
    return rows.select(*keys, F.explode(broken).alias("rule_id"))


def illegal_policies(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose action, repair_scope, had_text, recognition, reset_mode and reason are no legal combination."""
    spelled = lambda had: F.concat_ws("/", "action", "repair_scope", had, "recognition", "reset_mode", "reason")
    legal = ["/".join(p) for p in POLICIES]
    whole = F.col("had_text").isNotNull()
    return rows.filter(~(whole & (spelled(F.col("had_text").cast("string")).isin(*legal) | spelled(F.lit("any")).isin(*legal)))).select(*keys)


def with_task_class(rows: DataFrame) -> DataFrame:
    """Adds page_class and task_type from action and unresolved."""
    spelled = F.regexp_replace(F.lower(F.trim(F.coalesce("action", F.lit("")))), "-", "_")
    pick = lambda i: F.coalesce(*(F.when(~F.col("unresolved") & spelled.isin(*names), F.lit(kind[i])) for kind, names in CLASSES.items()), F.lit(BLOCKED[i]))
    return rows.withColumn("page_class", pick(0)).withColumn("task_type", pick(1))


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key and change (added, removed or changed) of what differs between snapshots."""
    a, b = before.select(key, F.col(digest).alias("was"), F.lit(True).alias("in_a")), after.select(key, F.col(digest).alias("now"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, key, "full_outer").withColumn("change", change).filter("change is not null").select(key, "change")
