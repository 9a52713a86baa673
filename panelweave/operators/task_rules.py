"""What a task of a queue may and must hold in each state, as a table of constraints, and how tasks, canaries and gates hang together; and the twelve states through which a page is promoted.

tasks have the columns of TASKS, gates those of GATES. Every finding is (project_id, entity, fault).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import content_hash
from panelweave.functions.text import page_id, trimmed, zoned_time

P = "project_id"
#: Task states, times of a task, types whose tasks wait for a canary.
STATES = ("queued", "leased", "completed", "failed")
TIMES = ("created_at", "updated_at", "queued_at", "leased_at", "completed_at", "failed_at")
EXPENSIVE = ("visual", "full_page_redraw")
_CANDIDATE, _FAILURE = ("candidate_path", "candidate_hash"), ("failure_code", "failure_record_id", "failure_timestamp", "failure_cluster", "failure_prompt")
#: By state, what a task must hold and what it must not.
MATRIX = {
    "queued": ((), ("completed_by", "lease_owner", "lease_expires_at", "leased_at", "completed_at", "failed_at", *_CANDIDATE, *_FAILURE)),
    "leased": (("lease_owner", "lease_expires_at", "leased_at"), ("completed_by", "completed_at", "failed_at", *_CANDIDATE, *_FAILURE)),
    "completed": (("completed_by", *_CANDIDATE, "completed_at"), ("lease_owner", "lease_expires_at", "failed_at", *_FAILURE)),
    "failed": (("failure_code", "failure_record_id", "failure_timestamp", "failed_at"), ("completed_by", "lease_owner", "lease_expires_at", "completed_at", *_CANDIDATE)),
}
TASKS = (
    "project_id string, task_id string, idempotency_key string, page_id string, task_type string, payload_hash string, cluster_id string, prompt_reference_hash string, state string, attempt_count bigint, " + ", ".join(f"{t} string" for t in TIMES)
    + f", timestamps struct<{','.join(f'{t}:string' for t in TIMES)}>, completed_by string, lease_owner string, lease_expires_at string, candidate_path string, candidate_hash string, candidate struct<path:string,hash:string>, failure_code string, failure_record_id string, "
    "failure struct<code:string,record_id:string,cluster_id:string,prompt_reference_hash:string,timestamp:string>, is_canary boolean, canary_task_id string"
)
GATES = "project_id string, task_id string, cluster_id string, approved boolean, review_id string, reviewed_by string, reviewed_at string"


def _told(c) -> Column:
    """Whether there is a character other than white space; as `trimmed`, without making the trimmed text."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).rlike(r"(?U)\S"), F.lit(False))


def _blank(c: str) -> Column:
    """There, but without a character."""
    return F.col(c).isNotNull() & ~_told(c)


def _timed(c) -> Column:
    return zoned_time(F.col(c) if isinstance(c, str) else c).isNotNull()


def _faults(rows: DataFrame, entity: str, **ok: Column) -> DataFrame:
    wrong = F.array_compact(F.array(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in ok.items())))
    return rows.select(P, F.col(entity).alias("entity"), F.explode(wrong).alias("fault"))


def matrix_faults(tasks: DataFrame) -> DataFrame:
    """(project_id, entity, fault) of fields that a task lacks or keeps in its state, by the table."""
    flat = tasks.withColumns({"failure_timestamp": F.col("failure.timestamp"), "failure_cluster": F.col("failure.cluster_id"), "failure_prompt": F.col("failure.prompt_reference_hash")})
    # the constraints of a task's own state alone are looked at
    lacks = lambda s, f: F.when(~_told(f), F.lit(f"{s}_lacks_{f}"))
    keeps = lambda s, f: F.when(F.col(f).isNotNull(), F.lit(f"{s}_keeps_{f}"))
    by_state = [F.when(F.col("state") == s, F.array(*(lacks(s, f) for f in must), *(keeps(s, f) for f in none))) for s, (must, none) in MATRIX.items()]
    return flat.select(P, F.col("task_id").alias("entity"), F.explode(F.array_compact(F.coalesce(*by_state))).alias("fault"))


def record_faults(tasks: DataFrame) -> DataFrame:
    """(project_id, entity, fault) of single tasks: names, ids of their content, times with a zone that agree, and copies of fields that agree."""
    made = tasks.withColumn("made_id", content_hash("page_id", "task_type", "payload_hash"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    stamps = {f"{t}_differs": same(t, f"timestamps.{t}") for t in TIMES} | {f"{t}_without_zone": F.col(t).isNull() | _timed(t) for t in TIMES} | {f"{t}_missing": F.col(t).isNotNull() for t in TIMES[:3]}
    failed, leased = F.col("state") == "failed", F.col("state") == "leased"
    return _faults(
        made, "task_id", state_unknown=F.col("state").isin(*STATES), task_id_missing=_told("task_id"), page_not_canonical=page_id(F.col("page_id")) == F.col("page_id"), task_type_missing=_told("task_type"), payload_hash_missing=_told("payload_hash"), canary_flag_missing=F.col("is_canary").isNotNull(),
        canary_task_id_blank=~_blank("canary_task_id"), canary_of_a_canary=~(F.coalesce("is_canary", F.lit(False)) & F.col("canary_task_id").isNotNull()), task_id_differs=F.col("task_id") == F.col("made_id"), idempotency_key_differs=F.col("idempotency_key").isNull() | same("idempotency_key", "task_id"),
        cluster_id_blank=~_blank("cluster_id"), prompt_reference_hash_blank=~_blank("prompt_reference_hash"), attempt_count_invalid=F.col("attempt_count") >= 0, timestamps_missing=F.col("timestamps").isNotNull(), **stamps,
        candidate_missing=F.col("candidate").isNotNull(), candidate_differs=F.col("candidate").isNull() | (same("candidate_path", "candidate.path") & same("candidate_hash", "candidate.hash")), failure_missing=F.col("failure").isNotNull(),
        failure_differs=F.col("failure").isNull() | (same("failure_code", "failure.code") & same("failure_record_id", "failure.record_id")), failure_time_without_zone=F.col("failure.timestamp").isNull() | _timed("failure.timestamp"), failure_time_differs=~failed | same("failure.timestamp", "failed_at"),
        failure_context_differs=~failed | (same("failure.cluster_id", "cluster_id") & same("failure.prompt_reference_hash", "prompt_reference_hash")), lease_expires_at_without_zone=~leased | F.col("lease_expires_at").isNull() | _timed("lease_expires_at"),
    )


def gate_faults(tasks: DataFrame, gates: DataFrame) -> DataFrame:
    """(project_id, entity, fault) of ids that repeat, canaries without a cluster or a gate, expensive tasks without a canary of their cluster, and gates that are no canary's, or approved or not against what they hold."""
    alone = F.count("*").over(Window.partitionBy(P, "task_id")) == 1
    gated = gates.select(P, "task_id").distinct().withColumn("gated", F.lit(True))
    lead = tasks.groupBy(P, F.col("task_id").alias("canary_task_id")).agg(F.max("is_canary").alias("leads"), F.min("cluster_id").alias("lead_cluster"))
    rows = tasks.withColumn("alone", alone).join(gated, [P, "task_id"], "left").join(lead, [P, "canary_task_id"], "left")
    canary, waits = F.coalesce("is_canary", F.lit(False)), F.col("canary_task_id").isNotNull()
    leads = F.coalesce("leads", F.lit(False))
    of_tasks = _faults(
        rows, "task_id", task_id_repeated=F.col("alone"), canary_without_cluster=~canary | F.col("cluster_id").isNotNull(), canary_without_gate=~canary | F.col("gated"), expensive_without_canary=canary | waits | ~F.col("task_type").isin(*EXPENSIVE), canary_unknown=~waits | leads,
        canary_of_another_cluster=~waits | ~leads | F.col("lead_cluster").eqNullSafe(F.col("cluster_id")),
    )
    held = tasks.groupBy(P, "task_id").agg(F.max("is_canary").alias("leads"), F.min("cluster_id").alias("lead_cluster"), F.min("state").alias("state"))
    at = gates.join(held, [P, "task_id"], "left")
    leads = F.coalesce("leads", F.lit(False))
    review = F.col("review_id").isNotNull() | F.col("reviewed_by").isNotNull() | F.col("reviewed_at").isNotNull()
    approved = F.coalesce("approved", F.lit(False))
    of_gates = _faults(
        at, "task_id", gate_of_no_canary=leads, gate_of_another_cluster=~leads | F.col("cluster_id").eqNullSafe(F.col("lead_cluster")), gate_undecided=F.col("approved").isNotNull(), approved_not_completed=~approved | (F.col("state") == "completed"),
        approval_unsigned=~approved | (_told("review_id") & _told("reviewed_by") & _timed("reviewed_at")), unapproved_keeps_review=approved | ~review,
    )
    return of_tasks.unionAll(of_gates)


def queue_faults(tasks: DataFrame, gates: DataFrame) -> DataFrame:
    """All findings in the tasks and gates of queues."""
    return reduce(DataFrame.unionAll, [record_faults(tasks), matrix_faults(tasks), gate_faults(tasks, gates)])


#: The states of a page on its way, in order, and how far back other events set it: to a lease for rework, behind the queue for a failure, behind the locks where evidence is missing.
PROMOTION = ("inventoried", "located", "locked", "classified", "queued", "leased", "candidate_ready", "preflight_passed", "independently_reviewed", "page_qa_passed", "cluster_qa_passed", "promoted")
SET_BACK = {"rework": 6, "failed": 4, "evidence_blocked": 3}


def promotion_faults(events: DataFrame) -> DataFrame:
    """(project_id, page_id, event_id, fault) of events (project_id, page_id, ts, event_id, state, candidate_hash) that skip a state, go back without being set back, are of no known state, or show a candidate again that was set back.

    Rework, a failure and missing evidence void what the page had passed beyond them: its next
    state has to be the one after the state to which it was set back, so QA passes of before
    count no longer.
    """
    ranks = F.create_map(*(F.lit(x) for pair in [*((s, i) for i, s in enumerate(PROMOTION, 1)), *SET_BACK.items()] for x in pair))
    page = Window.partitionBy(P, "page_id").orderBy("ts", "event_id")
    rows = events.withColumn("rank", ranks[F.col("state")]).withColumn("back", F.col("state").isin(*SET_BACK))
    # an unknown state leaves the page where it is
    was = F.coalesce(F.last("rank", ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turn = F.sum(F.col("back").cast("int")).over(page)
    rows = rows.withColumn("was", was).withColumn("turn", turn)
    rows = rows.withColumn("first_turn", F.min("turn").over(Window.partitionBy(P, "page_id", "candidate_hash", "state")))
    stale = (F.col("state") == "candidate_ready") & F.col("candidate_hash").isNotNull() & (F.col("first_turn") < F.col("turn"))
    faults = F.array(F.when(F.col("rank").isNull(), "state_unknown"), F.when(~F.col("back") & (F.col("rank") > F.col("was") + 1), "state_skipped"), F.when(~F.col("back") & (F.col("rank") <= F.col("was")), "moved_back"), F.when(stale, "candidate_shown_again"))
    return rows.select(P, "page_id", "event_id", F.explode(F.array_compact(faults)).alias("fault"))
