"""The learning store of many projects: content ids, rules promoted from failures with their sources and events, and checks of the whole store.

A project bounds what one rule can rest on, so lists of sources are lists of one project.
failures: project_id, failure_id, page_id, cluster_id, character, codes, corrective_action,
signature, effective, status, outcome_id, reviewed_by, reviewed_at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.text import trimmed
from panelweave.operators.audits import sorted_codes, unknown_codes
from panelweave.sources.shared import dealt, written

#: Scopes of rules, each of which rests on the one before.
SCOPES = ("page", "cluster", "project", "skill_candidate")
LEAST = {"cluster": 2, "project": 2, "skill_candidate": 1}
P = "project_id"


def content_id(kind: str, **fields: Column) -> Column:
    """kind and the SHA-256 of the compact JSON of the fields by name, nulls kept."""
    made = F.struct(*(value.alias(name) for name, value in sorted(fields.items())))
    return F.concat(F.lit(kind), F.sha2(F.to_json(made, {"ignoreNullFields": "false"}), 256))


def _named(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def signature() -> Column:
    """What makes failures the same: their codes and the corrective action."""
    return content_id("", **_named("codes", "corrective_action"))


def failure_id() -> Column:
    """Of page_id, cluster_id, character, codes, diagnosis, corrective_action, before_candidate (path, hash), prompt_reference_hash, created_at."""
    candidate = F.struct(F.col("before_candidate.hash").alias("hash"), F.col("before_candidate.path").alias("path"))
    return content_id("failure-", before_candidate=candidate, **_named("page_id", "cluster_id", "character", "codes", "diagnosis", "corrective_action", "prompt_reference_hash", "created_at"))


def outcome_id() -> Column:
    """Of failure_id, after_candidate (path, hash), effective, reviewed_by, reviewed_at."""
    candidate = F.struct(F.col("after_candidate.hash").alias("hash"), F.col("after_candidate.path").alias("path"))
    return content_id("outcome-", after_candidate=candidate, **_named("failure_id", "effective", "reviewed_by", "reviewed_at"))


def semantic_key() -> Column:
    """Where a rule applies: the page counts for page rules only, the cluster for cluster rules only."""
    of = lambda scope, c: F.when(F.col("scope") == scope, F.col(c))
    return content_id("", page_id=of("page", "page_id"), cluster_id=of("cluster", "cluster_id"), **_named("scope", "signature", "character"))


def rule_id() -> Column:
    return content_id("rule-", **_named("semantic_key", "scope", "signature", "page_id", "cluster_id", "character", "codes", "corrective_action", "source_failure_ids", "source_outcome_ids", "source_rule_ids", "promoted_by", "promoted_at"))


def event_id() -> Column:
    return content_id("event-", **_named("event_type", "rule_id", "from", "to", "from_scope", "to_scope", "evidence_ids", "reviewer", "timestamp", "reason"))


def _identified(rules: DataFrame, scope: str) -> DataFrame:
    made = rules.withColumn("scope", F.lit(scope)).withColumn("semantic_key", semantic_key())
    made = made.withColumn("rule_id", rule_id())
    return made.select(P, "rule_id", "semantic_key", "scope", "signature", "page_id", "cluster_id", "character", "codes", "corrective_action", "source_failure_ids", "source_outcome_ids", "source_rule_ids", "promoted_by", "promoted_at")


def promoted_rules(failures: DataFrame) -> DataFrame:
    """All rules that reviewed, effective failures support, by scope; each once, as rules of one semantic key are the same rule.

    A page rule rests on the failure of least id with its signature, page and character. A
    cluster rule needs page rules of two pages, a project rule cluster rules of two clusters,
    and a skill candidate a project rule. The failure of least id gives reviewer and time.
    """
    none = F.lit(None).cast("string")
    whole = ("signature", "character")
    first = F.min_by(F.struct("failure_id", "outcome_id", "cluster_id", "codes", "corrective_action", "reviewed_by", "reviewed_at"), "failure_id")
    seen = failures.filter("effective and status = 'reviewed'").groupBy(P, *whole, "page_id").agg(first.alias("f"))
    pages = seen.select(
        P, *whole, "page_id", F.col("f.cluster_id").alias("cluster_id"), F.col("f.codes").alias("codes"), F.col("f.corrective_action").alias("corrective_action"), F.array("f.failure_id").alias("source_failure_ids"), F.array("f.outcome_id").alias("source_outcome_ids"),
        F.array().cast("array<string>").alias("source_rule_ids"), F.col("f.reviewed_by").alias("promoted_by"), F.col("f.reviewed_at").alias("promoted_at"),
    )
    found = [_identified(pages, "page")]
    place = {"cluster": ("page_id", ("cluster_id",)), "project": ("cluster_id", ()), "skill_candidate": ("rule_id", ())}
    for scope in SCOPES[1:]:
        below, keys = place[scope]
        lead = F.min_by(F.struct("codes", "corrective_action", "promoted_by", "promoted_at"), F.element_at("source_failure_ids", 1))
        each = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        sources = found[-1] if scope != "cluster" else found[-1].filter(F.col("cluster_id").isNotNull())
        grouped = sources.groupBy(P, *whole, *keys).agg(F.countDistinct(below).alias("places"), lead.alias("lead"), each("source_failure_ids").alias("source_failure_ids"), each("source_outcome_ids").alias("source_outcome_ids"), F.array_sort(F.collect_set("rule_id")).alias("source_rule_ids"))
        made = grouped.filter(F.col("places") >= LEAST[scope]).withColumn("page_id", none)
        if not keys:
            made = made.withColumn("cluster_id", none)
        found.append(_identified(made.select("*", "lead.*").drop("lead", "places"), scope))
    return reduce(DataFrame.unionByName, found)


def promotion_events(rules: DataFrame) -> DataFrame:
    """The one event of each promotion: from the scope before (or what was observed), on the rules or else the outcomes that it rests on."""
    before = F.create_map(*(F.lit(x) for pair in zip(SCOPES, ("observed", *SCOPES)) for x in pair))[F.col("scope")]
    made = rules.select(
        P, "rule_id", F.lit("promoted").alias("event_type"), before.alias("from"), F.col("scope").alias("to"), before.alias("from_scope"), F.col("scope").alias("to_scope"),
        F.when(F.size("source_rule_ids") > 0, F.col("source_rule_ids")).otherwise(F.col("source_outcome_ids")).alias("evidence_ids"), F.col("promoted_by").alias("reviewer"), F.col("promoted_at").alias("timestamp"), F.lit(None).cast("string").alias("reason"),
    )
    return made.withColumn("event_id", event_id())


def judged_outcomes(failures: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row a failure, and one an outcome of no failure: the failure as its outcome leaves it, known (whether the failure is there) and fault (why the outcome is refused, else null).

    Failures and outcomes meet in one grouping by (project_id, failure_id), so tables that are
    already dealt by project are not dealt again. Columns as in `recorded_outcomes`.
    """
    given = ("after_candidate", "effective", "reviewed_by", "reviewed_at")
    own = [c for c in failures.columns if c not in (P, "failure_id")]
    as_failure, as_outcome = F.struct(*own), F.struct(*given)
    kinds = {"f": failures.select(as_failure).schema[0].dataType, "o": outcomes.select(as_outcome).schema[0].dataType}
    # an id that is not there is no other's: such rows get a key of their own
    own_key = lambda kind, said: F.when(F.col(P).isNull() | F.col("failure_id").isNull(), F.concat(F.lit(kind), F.xxhash64(said).cast("string")))
    side = lambda rows, kind, said: rows.select(P, "failure_id", own_key(kind, said).alias("apart"), *((said if k == kind else F.lit(None)).cast(of).alias(k) for k, of in kinds.items()))
    both = side(failures, "f", as_failure).unionAll(side(outcomes, "o", as_outcome)).groupBy(P, "failure_id", "apart").agg(F.collect_list("f").alias("held"), F.collect_list("o").alias("asked"))
    met = both.select(P, "failure_id", F.explode_outer("held").alias("f"), "asked").select(P, "failure_id", "f", F.explode_outer("asked").alias("o"))
    rows = met.select(P, "failure_id", F.col("f").isNotNull().alias("known"), F.col("o").isNotNull().alias("asked"), "f.*", *(F.col(f"o.{c}").alias(f"new_{c}") for c in given))
    told = lambda c: trimmed(c).isNotNull()
    done = F.col("status") == "reviewed"
    other = done & ~reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in given])
    new = F.col("new_after_candidate")
    faults = {
        "failure_unknown": F.col("status").isNull(), "candidate_unnamed": ~told(new["path"]) | ~F.coalesce(new["hash"].rlike("^[0-9a-f]{64}$"), F.lit(False)), "candidate_unchanged": new["hash"] == F.col("before_candidate.hash"),
        "verdict_missing": F.col("new_effective").isNull(), "review_unsigned": ~told(F.col("new_reviewed_by")) | ~told(F.col("new_reviewed_at")), "already_recorded": other,
    }
    fault = F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in faults.items()))
    made = rows.withColumn("fault", F.when(F.col("asked"), fault))
    made = made.withColumn("takes", F.coalesce(F.col("known") & F.col("asked") & ~done & F.col("fault").isNull(), F.lit(False)))
    made = made.withColumns({c: F.when(F.col("takes"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in given})
    made = made.withColumn("status", F.when(F.col("takes"), "reviewed").otherwise(F.col("status"))).withColumn("outcome_id", F.when(F.col("takes"), outcome_id()).otherwise(F.col("outcome_id")))
    return made.select(*failures.columns, "known", "fault")


def recorded_outcomes(failures: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The failures with the outcomes that were reviewed for them, each with its outcome_id, and (project_id, failure_id, fault) of outcomes that are refused.

    An outcome is recorded once: given again alike it changes nothing, given otherwise it is
    refused. failures: failure_id, before_candidate, after_candidate, effective, status,
    outcome_id, reviewed_by, reviewed_at; outcomes: project_id, failure_id, after_candidate
    (path, hash), effective, reviewed_by, reviewed_at, one for each failure.
    """
    judged = judged_outcomes(failures, outcomes)
    return judged.filter("known").select(*failures.columns), judged.filter("fault is not null").select(P, "failure_id", "fault")


def revoked(rules: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """The records that withdrawals change: the rules withdrawn, and all effective rules that rest on them by their recorded sources.

    A rule that several withdrawals reach falls by the first of them, in order of time and id.
    Sources lie one scope below, so three joins along source_rule_ids go all the way up. rules:
    also effective, revoked, revocation_reason, revoked_by, revoked_at; withdrawals:
    project_id, rule_id, reason, reviewed_by, reviewed_at, one for each rule. Withdrawals of
    rules that are unknown or already revoked change nothing; `refused_withdrawals` names them.
    """
    by = F.struct(F.col("reviewed_at").alias("revoked_at"), F.col("rule_id").alias("root"), F.col("reviewed_by").alias("revoked_by"), F.col("reason").alias("revocation_reason"))
    asked = withdrawals.select(P, "rule_id", by.alias("by"))
    # ids alone go through the joins
    standing = rules.filter("effective and not revoked").select(P, "rule_id", "scope", "source_rule_ids")
    edges = standing.select(P, "rule_id", "scope", F.explode("source_rule_ids").alias("source"))
    direct = standing.select(P, "rule_id", "scope").join(asked, [P, "rule_id"])
    fallen = direct.filter(F.col("scope") == SCOPES[0])
    hits = [fallen]
    for scope in SCOPES[1:]:
        below = fallen.select(P, F.col("rule_id").alias("source"), "by")
        led = edges.filter(F.col("scope") == scope).join(below, [P, "source"]).select(P, "rule_id", "scope", "by")
        fallen = led.unionByName(direct.filter(F.col("scope") == scope)).groupBy(P, "rule_id", "scope").agg(F.min("by").alias("by"))
        hits.append(fallen)
    found = reduce(DataFrame.unionByName, hits).select(P, "rule_id", "by")
    state = {"effective": F.lit(False), "revoked": F.lit(True), **{c: F.col(f"by.{c}") for c in ("revocation_reason", "revoked_by", "revoked_at")}}
    return rules.join(found, [P, "rule_id"]).select(*(state[c].alias(c) if c in state else F.col(c) for c in rules.columns))


def refused_withdrawals(rules: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """(project_id, rule_id, fault) of withdrawals that change nothing though they should: of no rule, unsigned, or of a rule that was revoked otherwise."""
    told = lambda c: trimmed(F.col(c)).isNotNull()
    held = rules.select(P, "rule_id", "revoked", "revocation_reason", "revoked_by", "revoked_at")
    other = F.col("revoked") & ~(F.col("revocation_reason").eqNullSafe(F.col("reason")) & F.col("revoked_by").eqNullSafe(F.col("reviewed_by")) & F.col("revoked_at").eqNullSafe(F.col("reviewed_at")))
    fault = F.when(F.col("revoked").isNull(), "rule_unknown").when(~told("reason") | ~told("reviewed_by") | ~told("reviewed_at"), "withdrawal_unsigned").when(other, "already_revoked")
    return withdrawals.join(held, [P, "rule_id"], "left").select(P, "rule_id", fault.alias("fault")).filter("fault is not null")


def revocation_events(changed: DataFrame) -> DataFrame:
    """The one event of each revoked record."""
    made = changed.select(
        P, "rule_id", F.lit("revoked").alias("event_type"), F.col("scope").alias("from"), F.lit("revoked").alias("to"), F.col("scope").alias("from_scope"), F.lit("revoked").alias("to_scope"),
        F.array("rule_id").alias("evidence_ids"), F.col("revoked_by").alias("reviewer"), F.col("revoked_at").alias("timestamp"), F.col("revocation_reason").alias("reason"),
    )
    return made.withColumn("event_id", event_id())


def with_changes(rules: DataFrame, events: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store's rules and events after a delta of records; the same delta again changes nothing."""
    kept = rules.join(changed.select(P, "rule_id"), [P, "rule_id"], "left_anti").select(*rules.columns)
    new = revocation_events(changed).join(events.select(P, "event_id"), [P, "event_id"], "left_anti")
    return kept.unionByName(changed.select(*rules.columns)), events.unionByName(new.select(*events.columns))


def _with_list(requests: DataFrame, lists: DataFrame, *keys: str) -> DataFrame:
    """The requests with the list of their project and keys, null where none is; null keys are alike. lists: project_id, the keys and one more column, a row for each value of the keys."""
    (name,) = set(lists.columns) - {P, *keys}
    both = requests.withColumn("asks", F.lit(True)).unionByName(dealt(lists).withColumn("asks", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy(P, *keys).orderBy("asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.first(name, ignorenulls=True).over(before)).filter("asks").drop("asks")


def applicable_rules(rules: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """key, rule_id, scope and place of each active rule that a request may use: of its page, its cluster or of all, for its character or all, sharing a code; by scope and then id.

    Rules are listed in order by the place that they hold for. Those of all places are found by
    an inverted index of their codes, once for all requests of one character and codes, so the
    work grows with the matches. Requests that are `dealt` by project meet the lists where they
    lie. rules: project_id, rule_id, scope, page_id, cluster_id, character, codes, revoked.
    requests: project_id, key (one row each), page_id, cluster_id, character, codes.
    """
    active = rules.filter("not revoked and project_id is not null").select(P, "rule_id", "scope", *(F.col(c).alias(f"of_{c}") for c in ("page_id", "cluster_id", "character", "codes")))
    of = lambda *scopes: active.filter(F.col("scope").isin(*scopes))
    ordered = lambda *fields: F.array_sort(F.collect_list(F.struct(*fields)))
    here = lambda scope, place: of(scope).filter(F.col(f"of_{place}").isNotNull()).groupBy(P, F.col(f"of_{place}").alias(place)).agg(ordered("rule_id", "scope", "of_character", "of_codes").alias(f"{scope}_rules"))
    whole = of("project", "skill_candidate").select(P, "rule_id", "scope", "of_character", F.explode(F.array_distinct("of_codes")).alias("code"))
    classes = requests.filter(F.col(P).isNotNull()).select(P, "character", "codes").distinct().select("*", F.explode(F.array_distinct("codes")).alias("code"))
    by_code = lambda rows, *more: classes.join(rows, [P, "code", *more]).select(P, "character", "codes", "rule_id", "scope")
    named = by_code(whole.filter("of_character is not null").withColumnRenamed("of_character", "character"), "character")
    met = named.unionByName(by_code(whole.filter("of_character is null"))).distinct()
    rank = F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope"))
    of_all = met.groupBy(P, "character", "codes").agg(ordered(rank.alias("rank"), "rule_id", "scope").alias("whole_rules"))
    rows = _with_list(_with_list(_with_list(requests, here("page", "page_id"), "page_id"), here("cluster", "cluster_id"), "cluster_id"), of_all, "character", "codes")
    fits = lambda r: (r["of_character"].isNull() | r["of_character"].eqNullSafe(F.col("character"))) & F.arrays_overlap(r["of_codes"], F.col("codes"))
    none = F.array().cast("array<struct<rule_id:string,scope:string>>")
    bare = lambda c: F.coalesce(F.transform(c, lambda r: F.struct(r["rule_id"].alias("rule_id"), r["scope"].alias("scope"))), none)
    found = F.concat(bare(F.filter("page_rules", fits)), bare(F.filter("cluster_rules", fits)), bare("whole_rules"))
    return rows.select(P, key, F.posexplode(found).alias("at", "r")).select(P, key, "r.rule_id", "r.scope", (F.col("at") + 1).alias("place"))


def source_facts(rules: DataFrame, failures: DataFrame) -> DataFrame:
    """project_id, rule_id and what is known of the failures that a rule names as its sources: lost (how many are not there), idle (not effective), outcomes, alike (of its signature and character) and here (of its page and cluster; both null without a source that is there).

    Sources and failures meet in one grouping by (project_id, failure_id), so failures that are `dealt` by project are not dealt again.
    """
    own = ("effective", "outcome_id", "signature", "character", "page_id", "cluster_id")
    told = ("rule_id", "signature", "character", "page_id", "cluster_id")
    kinds = {"f": failures.select(F.struct(*own)).schema[0].dataType, "s": rules.select(F.struct(*told)).schema[0].dataType}
    side = lambda rows, kind, said: rows.select(P, "failure_id", *((said if k == kind else F.lit(None)).cast(of).alias(k) for k, of in kinds.items()))
    sources = dealt(rules.select(P, *told, F.explode("source_failure_ids").alias("failure_id")))
    there = failures.filter(F.col(P).isNotNull() & F.col("failure_id").isNotNull())
    both = side(there, "f", F.struct(*own)).unionAll(side(sources, "s", F.struct(*told))).groupBy(P, "failure_id").agg(F.collect_list("f").alias("f"), F.collect_list("s").alias("s"))
    pairs = both.filter(F.size("s") > 0).select(P, F.explode("s").alias("s"), "f").select(P, "s", F.explode_outer("f").alias("f")).withColumn("rule_id", F.col("s.rule_id"))
    alike = lambda *names: F.when(F.col("f").isNotNull(), reduce(Column.__and__, [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in names]))
    return pairs.groupBy(P, "rule_id").agg(
        F.count_if(F.col("f.effective").isNull()).alias("lost"), F.count_if(~F.col("f.effective")).alias("idle"), F.array_sort(F.collect_list("f.outcome_id")).alias("outcomes"),
        F.min(alike("signature", "character")).alias("alike"), F.min(alike("page_id", "cluster_id")).alias("here"),
    )


def rule_faults(rules: DataFrame, failures: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(project_id, rule_id, fault) of rule records: unknown scope, codes out of order, a signature, key or id that is not of its content, a place that its scope must or must not have, broken or ineffective sources, and a state at odds with its revocation.

    rules have the columns of promoted_rules, effective, revoked, revocation_reason, revoked_by, revoked_at. facts: those of `source_facts`, where they are at hand.
    """
    told = lambda c: trimmed(F.col(c)).isNotNull()
    seen = (facts or source_facts(rules, failures)).select(P, "rule_id", "lost", "idle", "outcomes")
    ids = rules.select(P, F.col("rule_id").alias("source")).distinct().withColumn("there", F.lit(True))
    chain = rules.select(P, "rule_id", F.explode("source_rule_ids").alias("source")).join(ids, [P, "source"], "left").groupBy(P, "rule_id").agg(F.count_if(F.col("there").isNull()).alias("lost_rules"))
    rows = rules.join(seen, [P, "rule_id"], "left").join(chain, [P, "rule_id"], "left")
    scope = F.col("scope")
    ok = {
        "scope_unknown": scope.isin(*SCOPES), "codes_not_canonical": (F.col("codes") == sorted_codes(F.col("codes"))) & (F.size("codes") > 0) & (F.size(unknown_codes(F.col("codes"))) == 0), "signature_differs": F.col("signature") == signature(),
        "place_missing": ~((scope == "page") & F.col("page_id").isNull()) & ~((scope == "cluster") & F.col("cluster_id").isNull()), "place_not_allowed": ~scope.isin("project", "skill_candidate") | (F.col("page_id").isNull() & F.col("cluster_id").isNull()),
        "character_missing": told("character"), "semantic_key_differs": F.col("semantic_key") == semantic_key(), "sources_missing": F.size("source_failure_ids") > 0, "sources_not_canonical": (F.col("source_failure_ids") == F.array_sort(F.array_distinct("source_failure_ids"))) & (F.col("source_rule_ids") == F.array_sort(F.array_distinct("source_rule_ids"))),
        "failure_unknown": F.coalesce("lost", F.lit(0)) == 0, "failure_not_effective": F.coalesce("idle", F.lit(0)) == 0, "source_rule_unknown": F.coalesce("lost_rules", F.lit(0)) == 0, "outcomes_differ": F.coalesce("outcomes", F.array().cast("array<string>")) == F.col("source_outcome_ids"),
        "promotion_unsigned": told("promoted_by") & told("promoted_at"), "rule_id_differs": F.col("rule_id") == rule_id(),
        "state_differs": F.when(F.col("revoked"), ~F.col("effective") & told("revocation_reason") & told("revoked_by") & told("revoked_at")).otherwise(F.col("effective") & F.col("revocation_reason").isNull() & F.col("revoked_by").isNull() & F.col("revoked_at").isNull()),
    }
    faults = F.array_compact(F.array(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in ok.items())))
    return rows.select(P, "rule_id", F.explode(faults).alias("fault"))


def chain_faults(rules: DataFrame, failures: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(project_id, rule_id, fault) of rules that do not rest on the scope before: wrong scope, signature or character of a source, too few places, other failures than their sources', or active on a revoked source."""
    of = F.create_map(*(F.lit(x) for pair in zip(SCOPES[1:], SCOPES) for x in pair))
    base = rules.select(P, "rule_id", "scope", "signature", "character", "page_id", "cluster_id", "revoked", "source_failure_ids", "source_rule_ids")
    right = rules.select(P, F.col("rule_id").alias("source"), *(F.col(c).alias(f"s_{c}") for c in ("scope", "signature", "character", "page_id", "cluster_id", "revoked", "source_failure_ids")))
    joined = base.select(P, "rule_id", "scope", "signature", "character", "cluster_id", "revoked", F.explode("source_rule_ids").alias("source")).join(right, [P, "source"])
    same = lambda c: F.col(f"s_{c}").eqNullSafe(F.col(c))
    seen = joined.groupBy(P, "rule_id").agg(
        F.min(F.coalesce((F.col("s_scope") == of[F.col("scope")]) & same("signature") & same("character"), F.lit(False))).alias("fits"), F.min(same("cluster_id")).alias("one_cluster"), F.countDistinct("s_page_id").alias("pages"), F.countDistinct("s_cluster_id").alias("clusters"),
        F.max("s_revoked").alias("fallen"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s_source_failure_ids")))).alias("theirs"),
    )
    own = (facts or source_facts(rules, failures)).select(P, "rule_id", "alike", "here")
    rows = base.join(seen, [P, "rule_id"], "left").join(own, [P, "rule_id"], "left")
    page, none = F.col("scope") == "page", F.size("source_rule_ids") == 0
    ok = {
        "failure_differs": F.coalesce("alike", F.lit(True)), "page_rule_not_direct": ~page | (none & (F.size("source_failure_ids") == 1)), "page_rule_elsewhere": ~page | F.coalesce("here", F.lit(True)), "source_scope_wrong": page | (~none & F.coalesce("fits", F.lit(False))),
        "failures_not_bound": page | none | (F.col("theirs") == F.array_sort("source_failure_ids")), "too_few_places": page | none | ~F.col("scope").isin("cluster", "project") | (F.when(F.col("scope") == "cluster", F.col("pages")).otherwise(F.col("clusters")) >= 2),
        "clusters_differ": (F.col("scope") != "cluster") | none | F.col("one_cluster"), "active_on_revoked_source": page | none | ~F.col("fallen") | F.col("revoked"),
    }
    faults = F.array_compact(F.array(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in ok.items())))
    return rows.select(P, "rule_id", F.explode(faults).alias("fault"))


def event_faults(rules: DataFrame, events: DataFrame) -> DataFrame:
    """(project_id, rule_id, fault) of the audit log: events of no rule or of another content, and rules without exactly one promotion, or with revocations at odds with their state."""
    told = rules.select(P, "rule_id", "scope", "revoked", "promoted_by", "promoted_at", "revoked_by", "revoked_at", "revocation_reason", F.when(F.size("source_rule_ids") > 0, F.col("source_rule_ids")).otherwise(F.col("source_outcome_ids")).alias("wanted"))
    both = events.join(told.withColumn("there", F.lit(True)), [P, "rule_id"], "left").withColumn("copies", F.count("*").over(Window.partitionBy(P, "event_id")))
    before = F.create_map(*(F.lit(x) for pair in zip(SCOPES, ("observed", *SCOPES)) for x in pair))
    up = (F.col("to_scope") == F.col("scope")) & (F.col("from_scope") == before[F.col("to_scope")]) & F.col("reason").isNull() & (F.col("evidence_ids") == F.col("wanted")) & (F.col("reviewer") == F.col("promoted_by")) & (F.col("timestamp") == F.col("promoted_at"))
    down = (F.col("to_scope") == "revoked") & (F.col("from_scope") == F.col("scope")) & (F.col("evidence_ids") == F.array("rule_id")) & (F.col("reviewer") == F.col("revoked_by")) & (F.col("timestamp") == F.col("revoked_at")) & (F.col("reason") == F.col("revocation_reason"))
    ok = {
        "event_repeated": F.col("copies") == 1, "event_of_no_rule": F.col("there"), "event_id_differs": F.col("event_id") == event_id(), "scopes_differ": (F.col("from") == F.col("from_scope")) & (F.col("to") == F.col("to_scope")),
        "event_differs": F.col("there").isNull() | F.when(F.col("event_type") == "promoted", up).when(F.col("event_type") == "revoked", down),
    }
    wrong = F.array_compact(F.array(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in ok.items())))
    of_event = both.select(P, "rule_id", F.explode(wrong).alias("fault"))
    counts = events.groupBy(P, "rule_id").agg(F.count_if(F.col("event_type") == "promoted").alias("up"), F.count_if(F.col("event_type") == "revoked").alias("down"))
    rows = told.join(counts, [P, "rule_id"], "left").na.fill(0, ["up", "down"])
    count = F.array_compact(F.array(F.when(F.col("up") != 1, "promotions_not_one"), F.when(F.col("down") != F.col("revoked").cast("int"), "revocations_differ")))
    return of_event.unionAll(rows.select(P, "rule_id", F.explode(count).alias("fault")))


def store_faults(rules: DataFrame, failures: DataFrame, events: DataFrame) -> DataFrame:
    """(project_id, rule_id, fault) of the whole store: of records, of repeated ids and keys, of chains and of the audit log."""
    twice = lambda rows, key, name, entity: rows.groupBy(P, key).agg(F.count("*").alias("n"), F.min(entity).alias("named")).filter("n > 1").select(P, F.col("named").alias("rule_id"), F.lit(name).alias("fault"))
    repeated = [twice(failures, "failure_id", "failure_id_repeated", "failure_id"), twice(failures.filter("outcome_id is not null"), "outcome_id", "outcome_id_repeated", "outcome_id"), twice(rules, "rule_id", "rule_id_repeated", "rule_id"), twice(rules, "semantic_key", "semantic_key_repeated", "semantic_key")]
    facts = written(source_facts(rules, failures))
    return reduce(DataFrame.unionAll, [rule_faults(rules, failures, facts), chain_faults(rules, failures, facts), event_faults(rules, events), *repeated])
