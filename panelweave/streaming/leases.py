"""Keyed streams of task events: leases that run out, completions that do not hold, the circuit breaker of lanes, approvals.

Each key keeps its events until the watermark has passed them, and then takes them in order
of time and id. So a stream gives what the batch forms give on the same events, whatever
their order of arrival and however often one is sent again; an event that comes after the
watermark has passed its time is left out. A timer stands at the time of each event that
waits and at the end of each lease, so a lane that falls silent is served as well.

State is typed and bounded: the events inside the watermark's delay, one lease a lane, and
the streaks and pauses that are open. It needs a state store that keeps maps; `use_maps`
sets it for a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

from panelweave.operators.lanes import Breaker
from panelweave.operators.tasks import BREAK_AT

LATE = "1 hour"
HOUR = 3_600_000


def use_maps(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class StateMap:
    """A map of the state as a dict of single keys to tuples."""

    def __init__(self, kept: MapState):
        self.kept = kept

    def __contains__(self, key) -> bool:
        return self.kept.containsKey((key,))

    def __setitem__(self, key, value: tuple) -> None:
        self.kept.updateValue((key,), value)

    def get(self, key, default):
        return tuple(self.kept.getValue((key,))) if key in self else default

    def pop(self, key, default):
        value = self.get(key, default)
        if key in self:
            self.kept.removeKey((key,))
        return value


class InOrder(StatefulProcessor):
    """Takes a key's events (at, event_id and `fields`) in order once the watermark has passed them."""

    fields: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint, event_id bigint", self.fields)
        self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> None:
        """Open what else the processor keeps."""

    def taken(self, key: tuple, at: int, event: int, told: tuple):
        """Rows that an event gives."""
        raise NotImplementedError

    def passed(self, key: tuple, now: int):
        """Rows that time gives by itself, with all events up to now taken."""
        return ()

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentWatermarkInMs()
        names = [part.split()[0] for part in self.fields.split(",")]
        for row in rows:
            if row["at"] > now:
                self.waiting.updateValue((row["at"], row["event_id"]), tuple(row[n] for n in names))
                self.handle.registerTimer(row["at"])
        yield from self.due(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.due(key, timerValues.getCurrentWatermarkInMs())

    def due(self, key, now: int):
        for at, event in sorted(tuple(k) for k in self.waiting.keys() if k[0] <= now):
            told = tuple(self.waiting.getValue((at, event)))
            self.waiting.removeKey((at, event))
            yield from self.taken(tuple(key), at, event, told)
        yield from self.passed(tuple(key), now)

    def close(self) -> None:
        pass


class Leases(InOrder):
    """(lane, event_id, outcome, at): claims that ran out (`lease_expired`), and completions that are not of a live lease of their worker, with a candidate."""

    fields = "kind string, actor bigint, candidate boolean"

    def __init__(self, span: int):
        self.span = span

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.lease = handle.getValueState("lease", "event_id bigint, actor bigint, ends bigint")

    def expired(self, key: tuple, now: int):
        if self.lease.exists():
            event, _, ends = self.lease.get()
            if ends <= now:
                self.lease.clear()
                yield Row(lane=key[0], event_id=event, outcome="lease_expired", at=ends)

    def taken(self, key, at, event, told):
        kind, actor, candidate = told
        yield from self.expired(key, at)
        held = self.lease.get() if self.lease.exists() else None
        if kind == "complete":
            fault = None
            if held is None:
                fault = "not_leased"
            elif actor != held[1]:
                fault = "owner_mismatch"
            elif not candidate:
                fault = "no_candidate"
            if fault:
                yield Row(lane=key[0], event_id=event, outcome=fault, at=at)
        if kind == "claim":
            self.lease.update((event, actor, at + self.span))
            self.handle.registerTimer(at + self.span)
        elif held:
            self.lease.clear()

    def passed(self, key, now):
        yield from self.expired(key, now)


class Pauses(InOrder):
    """(project_id, lane, event_id, code, reason) of failures that pause their lane."""

    fields = "kind string, lane bigint, code bigint, prompt bigint"

    def __init__(self, break_at: int):
        self.break_at = break_at

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.breaker = Breaker(
            StateMap(handle.getMapState("lanes", "lane bigint", "code bigint, count bigint")),
            StateMap(handle.getMapState("prompts", "prompt bigint", "count bigint")),
            StateMap(handle.getMapState("paused", "lane bigint", "prompt bigint")),
        )

    def taken(self, key, at, event, told):
        kind, lane, code, prompt = told
        for found in self.breaker.walk([(lane, event, kind, code, prompt)], self.break_at):
            yield Row(project_id=key[0], lane=found[0], event_id=found[1], code=found[2], reason=found[3])


def lease_outcomes(events: DataFrame, hours: int = 6, late: str = LATE) -> DataFrame:
    """lane, event_id, outcome and at: leases that ran out, and completions that do not hold, as an append stream.

    A lease ends at its end, or at the lane's next event; what completes after either is `not_leased`. events: lane, event_id, kind and ts;
    actor (the worker) and candidate (one was given) where completions are checked for them.
    """
    has = lambda c, other: F.col(c) if c in events.columns else other
    told = events.withWatermark("ts", late).select("lane", "event_id", "kind", has("actor", F.lit(None).cast("bigint")).cast("bigint").alias("actor"), has("candidate", F.lit(True)).alias("candidate"), "ts", F.unix_millis("ts").alias("at"))
    found = told.groupBy("lane").transformWithState(Leases(hours * HOUR), "lane bigint, event_id bigint, outcome string, at bigint", "append", "EventTime")
    return found.select("lane", "event_id", "outcome", F.timestamp_millis("at").alias("at"))


def expired_leases(events: DataFrame, hours: int = 6, late: str = LATE) -> DataFrame:
    """lane, event_id and expired_at of claims whose lease ran out before the lane's next event."""
    return lease_outcomes(events, hours, late).filter("outcome = 'lease_expired'").select("lane", "event_id", F.col("at").alias("expired_at"))


def invalid_completions(events: DataFrame, hours: int = 6, late: str = LATE) -> DataFrame:
    """lane, event_id and reason of completions without a live lease, by another worker than the lease's, or without a candidate."""
    return lease_outcomes(events, hours, late).filter("outcome <> 'lease_expired'").select("lane", "event_id", F.col("outcome").alias("reason"))


def lane_pauses(events: DataFrame, break_at: int = BREAK_AT, late: str = LATE) -> DataFrame:
    """Failures that pause their lane, and why, as `lanes.pauses` finds them. Prompts couple the lanes of a project, so it is the key; what its state holds are open streaks and pauses."""
    moves = events.filter(F.col("kind").isin("fail", "complete", "reopen")).withWatermark("ts", late)
    told = moves.select("project_id", "lane", "event_id", "kind", F.col("code").cast("bigint").alias("code"), F.col("prompt").cast("bigint").alias("prompt"), "ts", F.unix_millis("ts").alias("at"))
    return told.groupBy("project_id").transformWithState(Pauses(break_at), "project_id bigint, lane bigint, event_id bigint, code bigint, reason string", "append", "EventTime")


def approval_verdict(worker: Column, reviewer: Column, done: Column) -> Column:
    """Whether a request to approve a canary holds: it is completed, and not reviewed by its worker, whatever the case of their names."""
    same = F.lower(worker.cast("string")) == F.lower(reviewer.cast("string"))
    return F.when(~done, "not_completed").when(worker.isNull(), "no_worker").when(same, "reviewer_is_worker").otherwise("approved")


def checked_approvals(approvals: DataFrame, completions: DataFrame, within: str = "7 days", late: str = LATE) -> DataFrame:
    """task_id, review_id and verdict of each request, from two streams.

    approvals: task_id, review_id, reviewer, ts; completions, one a task: task_id, worker, ts.
    A request looks back `within` for the task's completion; one that meets none is
    `not_completed` once the watermark says that none can come. Either side is kept no longer
    than that takes.
    """
    asked = approvals.withWatermark("ts", late).select("task_id", "review_id", "reviewer", F.col("ts").alias("asked_at"))
    done = completions.withWatermark("ts", late).select(F.col("task_id").alias("done_task"), "worker", F.col("ts").alias("done_at"))
    near = (F.col("task_id") == F.col("done_task")) & (F.col("done_at") <= F.col("asked_at")) & (F.col("done_at") >= F.col("asked_at") - F.expr(f"interval {within}"))
    return asked.join(done, near, "left_outer").select("task_id", "review_id", approval_verdict(F.col("worker"), F.col("reviewer"), F.col("done_task").isNotNull()).alias("verdict"))
