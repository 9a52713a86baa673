"""Task records: a sound queue has no finding, each mutation has its own; the twelve states of a page, one by one."""

import copy
import hashlib
import json
import re

import pytest

from panelweave.operators import task_rules as t
from panelweave.queries import QUERIES

TIME, OTHER = "2026-07-13T08:00:00Z", "2026-07-14T08:00:00+02:00"
MORE = {"queued": {}, "leased": {"lease_owner": "w", "lease_expires_at": OTHER, "leased_at": TIME}, "completed": {"completed_by": "w", "candidate_path": "p", "candidate_hash": "h", "completed_at": OTHER, "leased_at": TIME}, "failed": {"failure_code": "style_drift", "failure_record_id": "f", "failed_at": OTHER, "leased_at": TIME}}


def task(page, state, kind="text_repair", **more):
    row = {"page_id": page, "task_type": kind, "payload_hash": "x" + page, "cluster_id": "c1", "prompt_reference_hash": "h1", "state": state, "attempt_count": 1, "created_at": TIME, "updated_at": TIME, "queued_at": TIME, "is_canary": False, **MORE[state], **more}
    row = {**{f.split()[0]: None for f in ("idempotency_key", "canary_task_id", "completed_by", "lease_owner", "lease_expires_at", "candidate_path", "candidate_hash", "failure_code", "failure_record_id", *t.TIMES)}, **row}
    said = json.dumps({k: row[k] for k in ("page_id", "payload_hash", "task_type")}, sort_keys=True, separators=(",", ":"))
    row["task_id"] = hashlib.sha256(said.encode()).hexdigest()
    row["timestamps"] = {k: row[k] for k in t.TIMES}
    row["candidate"] = {"path": row["candidate_path"], "hash": row["candidate_hash"]}
    failed = state == "failed"
    row["failure"] = {"code": row["failure_code"], "record_id": row["failure_record_id"], "cluster_id": row["cluster_id"] if failed else None, "prompt_reference_hash": row["prompt_reference_hash"] if failed else None, "timestamp": row["failed_at"]}
    return row


def queue():
    canary = task("0001", "completed", "visual", is_canary=True)
    tasks = [canary, task("0002", "queued", "visual", canary_task_id=canary["task_id"]), task("0003", "leased"), task("0004", "completed"), task("0005", "failed", cluster_id=None, prompt_reference_hash=None)]
    return tasks, [{"task_id": canary["task_id"], "cluster_id": "c1", "approved": True, "review_id": "r", "reviewed_by": "q", "reviewed_at": TIME}]


def put(i, **values):
    def change(tasks, gates):
        for key, value in values.items():
            *path, last = key.split("__")
            held = tasks[i]
            for step in path:
                held = held[step]
            held[last] = value

    return change


def gate(**values):
    return lambda tasks, gates: gates[0].update(values)


Q, L, C, F_, LEAD = 1, 2, 3, 4, 0
MUTATIONS = {
    "state": (put(Q, state="open"), "state_unknown"), "page": (put(L, page_id="３.jpg"), "page_not_canonical task_id_differs"), "type": (put(L, task_type=" "), "task_type_missing task_id_differs"), "flag": (put(L, is_canary=None), "canary_flag_missing"),
    "canary of canary": (put(LEAD, canary_task_id="x"), "canary_of_a_canary canary_unknown"), "blank canary": (put(L, canary_task_id=" "), "canary_task_id_blank canary_unknown"), "id": (put(L, payload_hash="y"), "task_id_differs"), "key": (put(L, idempotency_key="x"), "idempotency_key_differs"),
    "cluster": (put(L, cluster_id=" "), "cluster_id_blank"), "prompt": (put(L, prompt_reference_hash=""), "prompt_reference_hash_blank"), "attempts": (put(L, attempt_count=-1), "attempt_count_invalid"), "nested": (put(L, timestamps__queued_at=OTHER), "queued_at_differs"),
    "zone": (put(L, updated_at="2026-07-13", timestamps__updated_at="2026-07-13"), "updated_at_without_zone"), "created": (put(L, created_at=None, timestamps__created_at=None), "created_at_missing"), "candidate": (put(C, candidate__hash="g"), "candidate_differs"), "failure": (put(F_, failure__code="x"), "failure_differs"),
    "failure time": (put(F_, failure__timestamp=TIME), "failure_time_differs"), "failure context": (put(F_, failure__cluster_id="c1"), "failure_context_differs"), "lease zone": (put(L, lease_expires_at="soon"), "lease_expires_at_without_zone"),
    "queued owner": (put(Q, lease_owner="w"), "queued_keeps_lease_owner"), "queued candidate": (put(Q, candidate_path="p", candidate__path="p"), "queued_keeps_candidate_path"), "queued end": (put(Q, failed_at=TIME, timestamps__failed_at=TIME), "queued_keeps_failed_at"), "leased without": (put(L, leased_at=None, timestamps__leased_at=None), "leased_lacks_leased_at"),
    "leased maker": (put(L, completed_by="w"), "leased_keeps_completed_by"), "leased failure": (put(L, failure__prompt_reference_hash="x"), "leased_keeps_failure_prompt"), "completed by nobody": (put(C, completed_by=" "), "completed_lacks_completed_by"), "completed lease": (put(C, lease_expires_at=TIME), "completed_keeps_lease_expires_at"),
    "completed failure": (put(C, failure_code="x", failure__code="x"), "completed_keeps_failure_code"), "failed without record": (put(F_, failure_record_id=None, failure__record_id=None), "failed_lacks_failure_record_id"), "failed candidate": (put(F_, candidate_hash="h", candidate__hash="h"), "failed_keeps_candidate_hash"),
    "repeated": (lambda tasks, gates: tasks.append(copy.deepcopy(tasks[L])), "task_id_repeated"), "no cluster": (put(LEAD, cluster_id=None), "canary_without_cluster canary_of_another_cluster gate_of_another_cluster"), "no gate": (lambda tasks, gates: gates.clear(), "canary_without_gate"),
    "no canary": (put(Q, canary_task_id=None), "expensive_without_canary"), "unknown canary": (put(Q, canary_task_id="x"), "canary_unknown"), "other cluster": (put(Q, cluster_id="c2"), "canary_of_another_cluster"), "gate of none": (gate(task_id="x"), "gate_of_no_canary approved_not_completed canary_without_gate"),
    "gate cluster": (gate(cluster_id="c2"), "gate_of_another_cluster"), "undecided": (gate(approved=None, review_id=None, reviewed_by=None, reviewed_at=None), "gate_undecided"), "unsigned": (gate(reviewed_by=" "), "approval_unsigned"), "kept review": (gate(approved=False), "unapproved_keeps_review"),
    "not completed": (lambda tasks, gates: tasks.__setitem__(LEAD, task("0001", "queued", "visual", is_canary=True)), "approved_not_completed"),
}


@pytest.fixture(scope="module")
def found(spark):
    tasks, gates = [], []
    for name, change in {"sound": lambda *_: None, **{n: c for n, (c, _) in MUTATIONS.items()}}.items():
        rows = queue()
        change(*rows)
        tasks += [{**r, "project_id": name} for r in rows[0]]
        gates += [{**r, "project_id": name} for r in rows[1]]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    seen = {}
    for r in t.queue_faults(frame(tasks, t.TASKS), frame(gates, t.GATES)).collect():
        seen.setdefault(r.project_id, set()).add(r.fault)
    return seen


@pytest.mark.parametrize("case", ["sound", *MUTATIONS])
def test_each_mutation_has_its_finding(found, case):
    assert found.get(case, set()) == (set(MUTATIONS[case][1].split()) if case in MUTATIONS else set())


def walk(spark, pages):
    rows = [("p", n, i, i, s, h) for n, states in enumerate(pages) for i, (s, h) in enumerate(states)]
    found = t.promotion_faults(spark.createDataFrame(rows, "project_id string, page_id long, ts long, event_id long, state string, candidate_hash string")).collect()
    return {n: sorted((r.event_id, r.fault) for r in found if r.page_id == n) for n in range(len(pages))}


def test_each_state_that_is_skipped(spark):
    whole = [(s, "h") for s in t.PROMOTION]
    found = walk(spark, [whole, *([x for j, x in enumerate(whole) if j != i] for i in range(11))])
    assert found[0] == [] and all(found[i + 1] == [(i, "state_skipped")] for i in range(11))


def test_rework_voids_what_was_passed(spark):
    start = [(s, "h") for s in t.PROMOTION[:10]]
    again = [(s, "g") for s in t.PROMOTION[6:]]
    found = walk(spark, [
        [*start, ("rework", None), *again], [*start, ("rework", None), ("cluster_qa_passed", None)], [*start, ("rework", None), ("candidate_ready", "h"), *again[1:]], [*start, ("failed", None), ("candidate_ready", "g")],
        [*start, ("failed", None), ("queued", None), ("leased", None), *again], [*start, ("evidence_blocked", None), ("classified", None)], [*start, ("located", None)], [*start, ("lost", None), ("cluster_qa_passed", None)],
    ])
    assert found == {0: [], 1: [(11, "state_skipped")], 2: [(11, "candidate_shown_again")], 3: [(11, "state_skipped")], 4: [], 5: [], 6: [(10, "moved_back")], 7: [(10, "state_unknown")]}


def test_workers_take_tasks_of_their_types(spark):
    from panelweave.operators.dispatch import eligible_tasks

    rows = [("p", i, i, i, 0, "l", False, "queued", False, "visual" if i % 2 else "text_repair") for i in range(6)]
    tasks = spark.createDataFrame(rows, "project_id string, task_id long, seq long, page_id long, cluster_id long, lane string, expensive boolean, state string, live boolean, task_type string")
    none, gates = tasks.limit(0).select("project_id", "lane"), spark.createDataFrame([], "project_id string, cluster_id long, task_id long, approved boolean")
    took = lambda types: sorted(r.task_id for r in eligible_tasks(tasks, none, gates, types=types).collect())
    assert took(None) == [0, 1, 2] and took(("visual",)) == [1, 3, 5] and took(()) == []


def test_text_requests_open_with_their_own_marker(spark):
    from pyspark.sql import functions as F

    from panelweave.operators import compiled as m

    made = m.text_requests(spark.createDataFrame([("1", "c", "block", "n", ["a"], 9)], "page_id string, cluster_id string, mode string, novel_hash string, allowed array<string>, budget int"), spark.createDataFrame([("1", 0, "p", "b", "s", "x", "y", 0, 1, None)], "page_id string, position int, panel_id string, balloon_id string, speaker_id string, source_text string, replacement string, start int, end int, reason string"))
    row = made.first()
    assert row.request.startswith(f"TEXT_PROMPT_VERSION={m.TEXT_VERSION}\n\n## TASK\n") and row.fingerprint
    recorded = made.unionByName(made.withColumn("request", F.concat(F.lit("x"), "request")))
    assert [r.fault for r in m.tampered(recorded, m.TEXT_VERSION, "page_id", marker=m.TEXT_MARKER).collect()] == ["header_invalid"]
    assert [r.fault for r in m.tampered(made, m.VERSION, "page_id").collect()] == ["header_invalid"]


def test_tasks_are_dealt_once_by_project_into_a_fixed_number(spark):
    plan = QUERIES["st6_task_faults"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\(o_orderkey#", plan)
    # copies within a queue are counted where its project lies
    assert not re.search(r"Window [^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange", plan)


def test_blank_in_any_script_is_not_told(spark):
    rows = [task(f"000{i}", "completed", completed_by=by) for i, by in enumerate((" \t\n", "　 ", " ", "", None, " w　"))]
    found = {r.entity for r in t.matrix_faults(spark.createDataFrame([{"project_id": "p", **r} for r in rows], t.TASKS)).collect() if r.fault == "completed_lacks_completed_by"}
    assert found == {r["task_id"] for r in rows[:5]}
