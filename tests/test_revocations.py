"""Revocations along recorded sources and outcomes on the store: what changes, what is refused, and that the store stays sound."""

import re

import pytest
from pyspark.sql import functions as F

from panelweave.operators import store
from panelweave.plans.store import _failures, _withdrawals, standing
from panelweave.queries import QUERIES
from panelweave.sources.shared import written

FOLDER = "/root/testdata/sf0.001"
WITHDRAWN = "project_id string, rule_id string, reason string, reviewed_by string, reviewed_at string"


@pytest.fixture(scope="module")
def held(spark):
    failures = written(_failures(spark, FOLDER))
    rules = written(standing(store.promoted_rules(failures)))
    return failures, rules, written(store.promotion_events(rules))


def plain(rules, withdrawals):
    """Withdrawals taken one after another, each walking up the rules that list a fallen one."""
    rules = {(r.project_id, r.rule_id): r.asDict() for r in rules}
    for w in sorted(withdrawals, key=lambda w: (w[4], w[1])):
        pending = [(w[0], w[1])]
        while pending:
            project, rule = pending.pop(0)
            now = rules.get((project, rule))
            if now is None or now["revoked"]:
                continue
            now.update(effective=False, revoked=True, revocation_reason=w[2], revoked_by=w[3], revoked_at=w[4])
            pending += [k for k, r in rules.items() if k[0] == project and r["effective"] and rule in r["source_rule_ids"]]
    return {k: (r["revocation_reason"], r["revoked_by"], r["revoked_at"]) for k, r in rules.items() if r["revoked"]}


def test_revocations_follow_the_sources_and_leave_a_sound_store(spark, held):
    failures, rules, events = held
    asked = written(_withdrawals(rules))
    changed = written(store.revoked(rules, asked))
    found = {(r.project_id, r.rule_id): (r.revocation_reason, r.revoked_by, r.revoked_at) for r in changed.collect()}
    assert found == plain(rules.collect(), asked.collect()) and {r.scope for r in changed.collect()} == set(store.SCOPES)
    after, log = map(written, store.with_changes(rules, events, changed))
    assert after.count() == rules.count() and log.count() == events.count() + changed.count()
    assert store.store_faults(after, failures, log).collect() == store.store_faults(rules, failures, events).collect() == []
    # the same delta, and the same withdrawals, again
    twice, log_twice = store.with_changes(after, log, changed)
    assert sorted(map(repr, twice.collect())) == sorted(map(repr, after.collect())) and log_twice.count() == log.count()
    assert store.revoked(after, asked).count() == 0 and store.refused_withdrawals(after, asked.join(changed.select("project_id", "rule_id", "revoked_at"), ["project_id", "rule_id"]).filter("revoked_at = reviewed_at").drop("revoked_at")).count() == 0


def test_withdrawals_that_change_nothing_are_named(spark, held):
    _, rules, _ = held
    first, second = rules.filter("scope = 'page'").orderBy("rule_id").limit(2).collect()
    gone = rules.withColumn("revoked", F.col("rule_id") == second.rule_id)
    rows = [(first.project_id, "rule-none", "why", "me", "t"), (first.project_id, first.rule_id, " ", "me", "t"), (second.project_id, second.rule_id, "why", "me", "t"), (first.project_id + "x", first.rule_id, "why", "me", "t")]
    found = {(r.project_id, r.rule_id): r.fault for r in store.refused_withdrawals(gone, spark.createDataFrame(rows, WITHDRAWN)).collect()}
    assert found == {(rows[0][0], "rule-none"): "rule_unknown", (rows[1][0], first.rule_id): "withdrawal_unsigned", (rows[2][0], second.rule_id): "already_revoked", (rows[3][0], first.rule_id): "rule_unknown"}


def test_projects_of_equal_rules_do_not_meet(spark, held):
    _, rules, _ = held
    both = rules.unionByName(rules.withColumn("project_id", F.concat("project_id", F.lit("-twin"))))
    asked = _withdrawals(rules)
    assert {r.project_id for r in store.revoked(both, asked).collect()} == {r.project_id for r in store.revoked(rules, asked).collect()}


def test_an_outcome_is_recorded_once(spark):
    kind = "struct<path:string,hash:string>"
    failures = f"project_id string, failure_id string, before_candidate {kind}, after_candidate {kind}, effective boolean, status string, outcome_id string, reviewed_by string, reviewed_at string, note string"
    asked = f"project_id string, failure_id string, after_candidate {kind}, effective boolean, reviewed_by string, reviewed_at string"
    a, b = ("p", "a" * 64), ("q", "b" * 64)
    rows = [("x", f"f{i}", a, None, None, "open", None, None, None, "n") for i in range(5)]
    given = [("x", "f0", b, True, "me", "t"), ("x", "f1", a, True, "me", "t"), ("x", "f2", ("q", "zz"), True, "me", "t"), ("x", "f3", b, True, None, "t"), ("y", "f4", b, True, "me", "t")]
    made, refused = store.recorded_outcomes(spark.createDataFrame(rows, failures), spark.createDataFrame(given, asked))
    assert {(r.project_id, r.failure_id): r.fault for r in refused.collect()} == {("x", "f1"): "candidate_unchanged", ("x", "f2"): "candidate_unnamed", ("x", "f3"): "review_unsigned", ("y", "f4"): "failure_unknown"}
    done = {r.failure_id: r for r in made.collect()}
    assert [i for i, r in done.items() if r.status == "reviewed"] == ["f0"] and done["f0"].outcome_id.startswith("outcome-") and done["f0"].note == "n"
    again, refused = store.recorded_outcomes(made, spark.createDataFrame([given[0]], asked))
    assert refused.count() == 0 and sorted(map(repr, again.collect())) == sorted(map(repr, made.collect()))
    _, refused = store.recorded_outcomes(made, spark.createDataFrame([("x", "f0", b, False, "me", "t")], asked))
    assert [r.fault for r in refused.collect()] == ["already_recorded"]


def test_a_request_meets_each_rule_once_however_many_codes_they_share(spark):
    rules = spark.createDataFrame([("x", "r1", "project", None, None, None, ["a", "b"], False), ("x", "r2", "skill_candidate", None, None, "c", ["b"], False), ("x", "r3", "page", "p", None, "c", ["a", "b"], False), ("y", "r4", "project", None, None, None, ["a"], False), ("x", "r5", "project", None, None, None, ["a"], True)], "project_id string, rule_id string, scope string, page_id string, cluster_id string, character string, codes array<string>, revoked boolean")
    asked = spark.createDataFrame([("x", "q1", "p", "k", "c", ["b", "a", "b"]), ("x", "q2", "o", "k", None, ["b"]), ("x", "q3", "p", None, "d", ["z"])], "project_id string, request string, page_id string, cluster_id string, character string, codes array<string>")
    found = [(r.request, r.rule_id, r.place) for r in store.applicable_rules(rules, asked, "request").orderBy("request", "place").collect()]
    assert found == [("q1", "r3", 1), ("q1", "r1", 2), ("q1", "r2", 3), ("q2", "r1", 1)]


def shuffled(df):
    """The columns by which a plan deals rows, exchange by exchange."""
    return re.findall(r"Exchange hashpartitioning\(([^\n]*?), \d+\), ", df._jdf.queryExecution().executedPlan().toString())


def test_outcomes_are_recorded_where_their_project_lies(spark):
    # both sides are dealt once, by project, before their texts and hashes are made
    keys = shuffled(QUERIES["p15_recorded_outcomes"](spark, FOLDER))
    assert keys and all(re.fullmatch(r"project_id#\d+", k) for k in keys)


def test_outcomes_without_ids_meet_nothing(spark):
    kind = "project_id string, failure_id string, before_candidate struct<path:string,hash:string>, after_candidate struct<path:string,hash:string>, effective boolean, status string, outcome_id string, reviewed_by string, reviewed_at string"
    failures = spark.createDataFrame([("p", f, ("b", "0" * 64), None, None, "open", None, None, None) for f in (None, None, "f", "f", "g")], kind)
    asked = spark.createDataFrame([("p", f, ("a", "1" * 64), True, "me", "t") for f in (None, "f", "h")], "project_id string, failure_id string, after_candidate struct<path:string,hash:string>, effective boolean, reviewed_by string, reviewed_at string")
    made, refused = store.recorded_outcomes(failures, asked)
    assert sorted((r.failure_id or "", r.status) for r in made.collect()) == [("", "open"), ("", "open"), ("f", "reviewed"), ("f", "reviewed"), ("g", "open")]
    assert sorted((r.failure_id or "", r.fault) for r in refused.collect()) == [("", "failure_unknown"), ("h", "failure_unknown")]


@pytest.mark.parametrize("name, narrow", [("g6_store_faults", "l_orderkey"), ("j13_rules_in_order", "l_orderkey")])
def test_failures_and_requests_are_dealt_once_by_project(spark, name, narrow):
    # no text made of a row's columns (ids, requests) is a key by which lineitem's rows are dealt
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().split("\n")
    above = [re.search(r"hashpartitioning\(([^\n]*?), \d+\)", line)[1] for line, below in zip(plan, plan[1:]) if "hashpartitioning" in line and f"{narrow}#" in below]
    assert above and all(re.fullmatch(r"project_id#\d+", k) for k in above)
