"""Streams give what the batch forms give: out of order, with repeats, over restarts, and with bounded state."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelweave.operators import dispatch, lanes
from panelweave.sources.tables import task_events
from panelweave.streaming import leases

FOLDER = "/root/testdata/sf0.001"
BASE = datetime(2026, 1, 1)
SCHEMA = "project_id long, lane long, event_id long, ts timestamp, kind string, code long, prompt long, actor long, candidate boolean"


def hour(n):
    return BASE + timedelta(hours=n)


@pytest.fixture(scope="module", autouse=True)
def maps(spark):
    leases.use_maps(spark)


@pytest.fixture(scope="module")
def events(spark):
    """The events of the table, and a last one in a project of its own that lets the watermark pass all others."""
    rows = task_events(spark, FOLDER).withColumn("ts", F.col("ts").cast("timestamp")).select("project_id", "lane", "event_id", "ts", "kind", "code", "prompt", (F.col("cache_key") % 5).alias("actor"), F.lit(True).alias("candidate")).collect()
    return rows


def last_event(rows):
    return (-1, -1, -1, max(r[3] for r in rows) + timedelta(days=30), "reopen", None, None, None, None)


class Feed:
    """A folder that a query is run over again and again, one file a run, from one checkpoint."""

    def __init__(self, spark, path, made, schema=SCHEMA):
        self.spark, self.path, self.made, self.schema = spark, str(path), made, schema

    def run(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")
        query = self.made(stream).writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(180)
        self.rows_kept = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None
        return query

    def out(self):
        return sorted(map(tuple, self.spark.read.parquet(f"{self.path}/out").collect()), key=repr)


def test_pauses_as_in_batch_in_disorder_with_repeats_and_restarts(spark, events, tmp_path):
    want = sorted(map(tuple, lanes.pauses(spark.createDataFrame(events, SCHEMA)).collect()), key=repr)
    rows = sorted(events, key=lambda r: (r.ts, r.event_id))
    third = len(rows) // 3
    feed = Feed(spark, tmp_path, lambda s: leases.lane_pauses(s, late="36 hours"))
    # each run is a restart; rows inside a part come in any order, and the second part repeats rows of the first that are not late
    feed.run(rows[:third][::-1])
    feed.run(rows[third - 5 : 2 * third][::-1])
    feed.run(rows[2 * third :][::-1])
    feed.run([last_event(rows)])
    assert want and feed.out() == want


def test_leases_and_completions_as_in_batch(spark, events, tmp_path):
    batch = spark.createDataFrame(events, SCHEMA)
    told = batch.selectExpr("*", "lead(ts) over (partition by lane order by ts, event_id) next").filter("kind = 'claim'")
    want = sorted((r.lane, r.event_id, "lease_expired") for r in told.filter("next is null or ts + interval 6 hours <= next").collect())
    lane = "(partition by lane order by ts, event_id)"
    others = batch.selectExpr("*", f"lag(kind) over {lane} was", f"lag(actor) over {lane} owner").filter("kind = 'complete' and was = 'claim' and not actor <=> owner")
    faults = {(r.lane, r.event_id): "not_leased" for r in dispatch.invalid_completions(batch).collect()}
    faults |= {(r.lane, r.event_id): "owner_mismatch" for r in others.collect() if (r.lane, r.event_id) not in faults}
    rows = sorted(events, key=lambda r: (r.ts, r.event_id))
    feed = Feed(spark, tmp_path, lambda s: leases.lease_outcomes(s).drop("at"))
    feed.run(rows[: len(rows) // 2])
    feed.run(rows[len(rows) // 2 :])
    feed.run([last_event(rows)])
    assert feed.out() == sorted(want + [(*k, v) for k, v in faults.items()], key=repr)


def test_a_timer_serves_a_silent_lane_and_late_events_are_left_out(spark, tmp_path):
    event = lambda lane, n, at, kind, actor=1, candidate=True: (1, lane, n, hour(at), kind, None, None, actor, candidate)
    feed = Feed(spark, tmp_path, lambda s: leases.lease_outcomes(s).drop("at"))
    feed.run([event(1, 1, 0, "claim"), event(2, 2, 0, "claim"), event(3, 3, 0, "claim"), event(4, 4, 0, "claim"), event(5, 5, 1, "complete")])
    feed.run([event(2, 6, 5, "complete", 9), event(3, 7, 5, "complete", 1, False), event(4, 8, 5, "complete"), event(9, 9, 20, "add")])
    # lane 1 fell silent; its completion in time comes after the watermark has passed it
    feed.run([event(1, 10, 3, "complete"), event(9, 11, 40, "add")])
    feed.run([event(9, 12, 80, "add")])
    assert feed.out() == [(1, 1, "lease_expired"), (2, 6, "owner_mismatch"), (3, 7, "no_candidate"), (5, 5, "not_leased")]


def test_the_breaker_keeps_open_lanes_only(spark, tmp_path):
    event = lambda lane, n, at, kind, prompt=None: (1, lane, n, hour(at), kind, 7, prompt, None, None)
    feed = Feed(spark, tmp_path, leases.lane_pauses)
    feed.run([event(lane, 10 * lane + k, k, "fail", lane) for lane in range(1, 21) for k in range(2)])
    feed.run([event(lane, 10 * lane + 5, 30, "complete", lane) for lane in range(1, 20)])
    feed.run([event(20, 500, 60, "fail", 20)])
    feed.run([(2, 0, 900, hour(200), "fail", 1, None, None, None)])
    feed.run([(2, 0, 901, hour(400), "complete", 1, None, None, None)])
    feed.run([(2, 0, 902, hour(600), "complete", 1, None, None, None)])
    assert feed.out() == [(1, 20, 500, 7, "lane_failure_streak")]
    # lane 20: its streak, its prompt and its pause; project 2: the event that waits; a row each for its timer
    assert feed.rows_kept <= 8


def test_approvals_from_two_streams(spark, tmp_path):
    asks, ends = "task_id long, review_id long, reviewer string, ts timestamp", "task_id long, worker string, ts timestamp"
    steps = [
        ([(1, 10, "Bo", hour(5)), (2, 20, "ANN", hour(5)), (3, 30, "Cy", hour(5)), (4, 40, "Di", hour(2))], [(1, "Ann", hour(1)), (2, "ann", hour(1)), (4, "Ed", hour(3)), (5, None, hour(1))]),
        ([(5, 50, "Fo", hour(300)), (6, 60, "Gy", hour(300))], [(6, "Ha", hour(1)), (7, "Ha", hour(300))]),
        ([(9, 90, "x", hour(900)), (7, 70, "Io", hour(2))], [(9, "y", hour(900))]),
        ([(9, 91, "x", hour(1500))], [(8, "y", hour(1500))]),
    ]
    for asked, done in steps:
        spark.createDataFrame(asked, asks).coalesce(1).write.mode("append").parquet(f"{tmp_path}/asked")
        spark.createDataFrame(done, ends).coalesce(1).write.mode("append").parquet(f"{tmp_path}/done")
        made = leases.checked_approvals(spark.readStream.schema(asks).parquet(f"{tmp_path}/asked"), spark.readStream.schema(ends).parquet(f"{tmp_path}/done"))
        query = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    found = {r.review_id: r.verdict for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # 40 asked before its task was done; 50 and 60 look back a week only; 70 came late; 91 waits for the watermark
    assert found == {10: "approved", 20: "reviewer_is_worker", 30: "not_completed", 40: "not_completed", 50: "not_completed", 60: "not_completed", 90: "approved"}


def test_late_events_are_dropped_and_repeated_adds_are_not(spark, tmp_path):
    """An event older than the watermark counts in no window; an add is repeated at any time without a second row."""
    from panelweave.streaming.events import unique_adds, window_metrics

    day = lambda n: datetime(2026, 1, 1, 12) + timedelta(days=n)
    schema = "lane long, ts timestamp, kind string, event_id long"
    # one file a batch: time moves to day 10, then an event of day 1 comes late, then time moves on
    for n, rows in enumerate(([(1, day(1), "add", 1), (1, day(10), "fail", 2)], [(2, day(1), "fail", 3), (1, day(9), "add", 4), (3, day(10), "add", 5)], [(1, day(30), "add", 6)], [(9, day(60), "fail", 7)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/events")
        for name, made, mode in (("late_metrics", window_metrics(stream), "append"), ("late_adds", unique_adds(stream), "append")):
            made.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    counts = {r.start.date().day: (r.n_add, r.n_fail) for r in spark.read.parquet(f"{tmp_path}/late_metrics").filter("start < '2026-01-20'").collect()}
    assert counts == {2: (1, 0), 10: (1, 0), 11: (1, 1)}
    assert sorted(r.lane for r in spark.read.parquet(f"{tmp_path}/late_adds").collect()) == [1, 3]
