"""Order of task events: the circuit breaker of lanes, canary gates, lease expiry, illegal moves and hand-offs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.tasks import BREAK_AT

#: The moves that a task may make, and the rank of each state.
MOVES = ("add>claim", "claim>claim", "claim>complete", "claim>fail", "fail>reopen", "reopen>claim")
RANKS = {"add": 1, "claim": 2, "complete": 3, "fail": 3, "reopen": 4}


class Breaker:
    """The streaks and paused lanes of one project, in three maps: lane -> (code, count), prompt -> (count,), lane -> (prompt it was paused under,).

    What completes or reopens leaves the maps, so they hold open lanes and prompts only. A
    stream passes maps that are its state.
    """

    def __init__(self, lanes=None, prompts=None, paused=None) -> None:
        self.lanes, self.prompts, self.paused = ({} if held is None else held for held in (lanes, prompts, paused))

    def failed(self, lane, prompt, code, break_at: int) -> str | None:
        """Counts a failure; the reason if it pauses the lane, which a paused lane does not do again."""
        last, count = self.lanes.get(lane, (None, 0))
        count = count + 1 if count and last == code else 1
        self.lanes[lane] = (code, count)
        of_prompt = 0
        if prompt is not None:
            (of_prompt,) = self.prompts.get(prompt, (0,))
            of_prompt += 1
            self.prompts[prompt] = (of_prompt,)
        if max(count, of_prompt) < break_at or lane in self.paused:
            return None
        self.paused[lane] = (prompt,)
        return "lane_failure_streak" if count >= break_at else "prompt_failure_streak"

    def completed(self, lane, prompt) -> None:
        self.lanes.pop(lane, None)
        if prompt is not None:
            self.prompts.pop(prompt, None)

    def reopened(self, lane) -> None:
        self.lanes.pop(lane, None)
        (prompt,) = self.paused.pop(lane, (None,))
        if prompt is not None:
            self.prompts.pop(prompt, None)

    def walk(self, moves, break_at: int):
        """(lane, event, code, reason) of each failure among (lane, event, kind, code, prompt) that pauses its lane."""
        for lane, event, kind, code, prompt in moves:
            if kind == "complete":
                self.completed(lane, prompt)
            elif kind == "reopen":
                self.reopened(lane)
            elif reason := self.failed(lane, prompt, code, break_at):
                yield lane, event, code, reason


def pauses(events: DataFrame, break_at: int = BREAK_AT) -> DataFrame:
    """Failures that pause their lane, and why. Lanes of a project are coupled by its prompts.

    A streak of one code in the lane, or of one prompt in the project, pauses; success clears
    streaks but reopens nothing; reopening clears the lane and the prompt it was paused under.
    The fold reads sorted partitions and holds one project's lanes, not its events.
    """

    def work(frames):
        name, project = None, Breaker()
        for frame in frames:
            found = []
            for owner, *move in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None):
                if owner != name:
                    name, project = owner, Breaker()
                found += [(owner, *hit) for hit in project.walk([move], break_at)]
            yield pd.DataFrame(found, columns=["project_id", "lane", "event_id", "code", "reason"])

    moves = events.filter(F.col("kind").isin("fail", "complete", "reopen"))
    told = moves.repartition("project_id").sortWithinPartitions("project_id", "ts", "event_id").select("project_id", "lane", "event_id", "kind", "code", "prompt")
    return told.mapInPandas(work, "project_id bigint, lane bigint, event_id bigint, code bigint, reason string")


def canary_gates(events: DataFrame) -> DataFrame:
    """By lane: its first task as canary, whether that is approved, and how many later claims wait for it."""
    at = F.struct("ts", "event_id")
    lanes = events.groupBy("lane").agg(F.min_by("event_id", at).alias("canary"), F.min_by("kind", at).alias("first_kind"), F.max(F.col("kind") == "complete").alias("approved"), F.count_if(F.col("kind") == "claim").alias("claims"))
    later = F.col("claims") - (F.col("first_kind") == "claim").cast("bigint")
    return lanes.select("lane", "canary", "approved", F.when(F.col("approved"), F.lit(0)).otherwise(later).cast("bigint").alias("waiting"))


def lease_ends(events: DataFrame, hours: int = 6) -> DataFrame:
    """By project: claims, those whose lease had run out when the lane's next event came, and those without a next event."""
    lane = Window.partitionBy("lane").orderBy("ts", "event_id")
    claims = events.withColumn("next", F.lead("ts").over(lane)).filter("kind = 'claim'").withColumn("ends", F.col("ts") + F.expr(f"interval {hours} hours"))
    return claims.groupBy("project_id").agg(F.count("*").alias("claims"), F.count_if(F.col("ends") <= F.col("next")).alias("expired"), F.count_if(F.col("next").isNull()).alias("open"))


def _steps(events: DataFrame) -> DataFrame:
    lane = Window.partitionBy("lane").orderBy("ts", "event_id")
    return events.withColumn("was", F.lag("kind").over(lane))


def illegal_moves(events: DataFrame) -> DataFrame:
    """Events that may not follow the one before them in the lane."""
    return _steps(events).filter(F.col("was").isNotNull() & ~F.concat_ws(">", "was", "kind").isin(*MOVES)).select("lane", "event_id", "was", "kind")


def skipped_states(events: DataFrame) -> DataFrame:
    """Events whose state is more than one rank above the one before."""
    rank = lambda c: F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))[F.col(c)]
    return _steps(events).filter(rank("kind") > rank("was") + 1).select("lane", "event_id", "was", "kind")


def unexplained_handoffs(events: DataFrame) -> DataFrame:
    """Claims under another code than the lane's claim before, with no completion between them."""
    lane = Window.partitionBy("lane").orderBy("ts", "event_id")
    claims = events.withColumn("transfers", F.count_if(F.col("kind") == "complete").over(lane)).filter("kind = 'claim'")
    told = claims.withColumn("was_code", F.lag("code").over(lane)).withColumn("was_transfers", F.lag("transfers").over(lane))
    return told.filter("was_code <> code and was_transfers = transfers").select("lane", "event_id", "was_code", "code")


def first_adds(events: DataFrame) -> DataFrame:
    """Idempotent add: the first add of each lane, and how many repeats were left out."""
    adds = events.filter("kind = 'add'")
    return adds.groupBy("lane").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), (F.count("*") - 1).alias("repeats"))
