"""Tasks as rows: their state matrix, what may be leased next, and completions or approvals that do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORKERS = 3
LEASE_HOURS = 6


def task_rows(events: DataFrame) -> DataFrame:
    """One row a task (lane): state, attempts, and the last times of lease, completion and failure."""
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("ts")))
    last = F.max_by("kind", F.struct("ts", "event_id"))
    state = F.when(F.col("last").isin("add", "reopen"), "queued").when(F.col("last") == "claim", "leased").when(F.col("last") == "complete", "completed").when(F.col("last") == "fail", "failed")
    held = events.groupBy("project_id", "lane").agg(last.alias("last"), F.count_if(F.col("kind") == "claim").alias("attempts"), F.min(F.struct("ts", "event_id")).alias("first"), at("claim").alias("leased_at"), at("complete").alias("completed_at"), at("fail").alias("failed_at"))
    return held.withColumn("state", state)


def state_faults(tasks: DataFrame) -> DataFrame:
    """lane and fault for what a task may not hold, or lacks, in its state."""
    state, has = F.col("state"), lambda c: F.col(c).isNotNull()
    rules = {
        "queued_keeps_lease": (state == "queued") & has("leased_at"), "queued_keeps_end": (state == "queued") & (has("completed_at") | has("failed_at")),
        "leased_keeps_end": (state == "leased") & (has("completed_at") | has("failed_at")), "completed_keeps_failure": (state == "completed") & has("failed_at"),
        "failed_keeps_completion": (state == "failed") & has("completed_at"), "ended_without_lease": state.isin("completed", "failed") & ~has("leased_at"),
    }
    return tasks.select("lane", F.explode(F.array_compact(F.array(*(F.when(f, F.lit(n)) for n, f in rules.items())))).alias("fault"))


def next_tasks(events: DataFrame, workers: int = WORKERS, hours: int = LEASE_HOURS) -> DataFrame:
    """Queued tasks that free workers take next, in queue order within the project. A lease is live at the project's last event."""
    tasks = task_rows(events)
    ends = F.col("leased_at") + F.expr(f"interval {hours} hours")
    clock = events.groupBy("project_id").agg(F.max("ts").alias("now"))
    busy = tasks.filter("state = 'leased'").join(clock, "project_id").filter(ends > F.col("now")).groupBy("project_id").agg(F.count("*").alias("busy"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("first", "lane"))
    queued = tasks.filter("state = 'queued'").withColumn("place", place.cast("bigint")).filter(F.col("place") <= workers)
    return queued.join(busy, "project_id", "left").filter(F.col("place") <= workers - F.coalesce("busy", F.lit(0))).select("project_id", "lane", "place")


def eligible_tasks(tasks: DataFrame, paused: DataFrame, canaries: DataFrame, workers: int = WORKERS, types: tuple[str, ...] | None = None) -> DataFrame:
    """The queued tasks that free workers of each project take next, in queue order: of no paused lane, not waiting for a canary of their cluster, on a page that nobody works on.

    types: the task types that the workers take, all by default; tasks have task_type then. tasks: project_id, task_id, seq, page_id, cluster_id, lane, expensive, state, live (its lease runs). paused: project_id, lane. canaries: project_id, cluster_id, task_id, approved.
    """
    leased = tasks.filter("state = 'leased' and live")
    busy = leased.groupBy("project_id").agg(F.count("*").alias("busy"))
    wanted = tasks.filter("state = 'queued'") if types is None else tasks.filter(F.col("task_type").isin(*types) & (F.col("state") == "queued"))
    queued = wanted.join(paused, ["project_id", "lane"], "left_anti").join(leased.select("project_id", "page_id").distinct(), ["project_id", "page_id"], "left_anti")
    gates = canaries.select("project_id", "cluster_id", F.col("task_id").alias("canary"), "approved")
    gated = queued.join(gates, ["project_id", "cluster_id"], "left").filter(~F.col("expensive") | F.coalesce("approved", F.lit(False)) | F.col("canary").eqNullSafe(F.col("task_id")))
    # of two tasks on one page the first in the queue goes
    first = gated.withColumn("on_page", F.row_number().over(Window.partitionBy("project_id", "page_id").orderBy("seq"))).filter("on_page = 1")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy("seq")).cast("bigint")).filter(F.col("place") <= workers)
    return placed.join(busy, "project_id", "left").filter(F.col("place") <= workers - F.coalesce("busy", F.lit(0))).select("project_id", "task_id", "place")


def retries_by_code(events: DataFrame) -> DataFrame:
    """By project and code: failures, and the claims beyond the first that each failure took since its lane last ended a task."""
    lane = Window.partitionBy("lane").orderBy("ts", "event_id")
    ended = F.coalesce(F.sum(F.col("kind").isin("complete", "fail").cast("int")).over(lane.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    claims = F.count_if(F.col("kind") == "claim").over(Window.partitionBy("lane", "turn"))
    failed = events.withColumn("turn", ended).withColumn("claims", claims).filter("kind = 'fail'")
    return failed.groupBy("project_id", "code").agg(F.count("*").alias("failures"), F.sum(F.greatest(F.col("claims") - 1, F.lit(0))).alias("retries"))


def attempt_metrics(events: DataFrame) -> DataFrame:
    """By project: share of finished tasks that were completed on the first attempt, and retries."""
    rate = F.coalesce(F.try_divide(F.count_if((F.col("state") == "completed") & (F.col("attempts") <= 1)), F.count_if(F.col("state").isin("completed", "failed"))), F.lit(0.0))
    return task_rows(events).groupBy("project_id").agg(F.round(rate, 6).alias("first_pass_rate"), F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"))


def invalid_completions(events: DataFrame, hours: int = LEASE_HOURS) -> DataFrame:
    """Completions whose lane was not leased just before, or whose lease had run out (it does at its end)."""
    lane = Window.partitionBy("lane").orderBy("ts", "event_id")
    told = events.withColumn("was", F.lag("kind").over(lane)).withColumn("since", F.lag("ts").over(lane)).filter("kind = 'complete'")
    late = F.col("since") + F.expr(f"interval {hours} hours") <= F.col("ts")
    reason = F.when(~F.col("was").eqNullSafe(F.lit("claim")), "not_leased").when(late, "lease_expired")
    return told.select("lane", "event_id", reason.alias("reason")).filter("reason is not null")


def approvals(events: DataFrame) -> DataFrame:
    """Requests to approve a lane's canary, and whether they hold: after a completion, and not by the worker of the last claim. events have actor."""
    ahead = Window.partitionBy("lane").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    told = events.withColumn("done", F.count_if(F.col("kind") == "complete").over(ahead)).withColumn("worker", F.last(F.when(F.col("kind") == "claim", F.col("actor")), ignorenulls=True).over(ahead))
    verdict = F.when(F.col("done") == 0, "not_completed").when(F.col("worker").isNull(), "no_worker").when(F.col("worker") == F.col("actor"), "reviewer_is_worker").otherwise("approved")
    return told.filter("kind = 'reopen'").select("lane", "event_id", verdict.alias("verdict"))
