"""Sequential operators against fixed values and plain restatements, and the stream forms against the batch ones."""

import random

import pandas as pd
from pyspark.sql import functions as F

from panelweave.operators import clusters, lanes, rules
from panelweave.sources.tables import task_events
from panelweave.streaming.events import unique_adds, window_metrics

PAGES = "project_id string, page_id long, chapter string, location string, story_time string, scene_id string, risk double"
FOLDER = "/root/testdata/sf0.001"


def pages_of(spark, scenes, risks=()):
    """scenes: (number of pages, chapter, location, scene)."""
    rows, n = [], 0
    for count, chapter, location, scene in scenes:
        for _ in range(count):
            rows.append(("p", n + 1, chapter, location, "day", scene, risks[n] if n < len(risks) else None))
            n += 1
    return spark.createDataFrame(rows, PAGES)


def test_two_full_clusters(spark):
    rows = clusters.scene_clusters(pages_of(spark, [(20, "c", "l", "s")]), most=10).orderBy("cluster").collect()
    assert [(r["size"], r.before, r.after) for r in rows] == [(10, "", "11,12"), (10, "9,10", "")]


def test_short_chunks_merge_in_a_location_only(spark):
    rows = clusters.scene_clusters(pages_of(spark, [(4, "c", "l", "a"), (4, "c", "l", "b"), (4, "d", "l", "c")])).orderBy("cluster").collect()
    assert [(r["size"], r.scene_id, r.blocked) for r in rows] == [(8, "mixed", False), (4, "c", True)]
    rows = clusters.scene_clusters(pages_of(spark, [(4, "c", "l", "a"), (4, "c", "m", "a")])).collect()
    assert [(r["size"], r.blocked) for r in rows] == [(4, True)] * 2
    rows = clusters.scene_clusters(pages_of(spark, [(4, "c", None, "a"), (4, "c", " ", "b")])).collect()
    assert [(r["size"], r.location) for r in rows] == [(4, "unknown")] * 2


def test_small_project_and_canaries(spark):
    row = clusters.scene_clusters(pages_of(spark, [(4, "c", "l", "a")])).first()
    assert (row.undersized_reason, row.blocked, row.canary) == ("project_total_below_min", False, 2)
    assert clusters.scene_clusters(pages_of(spark, [(4, "c", "l", "a")], [1.0, 9.0, 9.0, 2.0])).first().canary == 2
    assert clusters.scene_clusters(pages_of(spark, [])).count() == 0


def test_merged_groups_keep_order_and_size():
    rng = random.Random(5)
    for _ in range(500):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 12))]
        groups = clusters.merged_groups(sizes, 8, 20)
        totals = [sum(s for s, g in zip(sizes, groups) if g == x) for x in sorted(set(groups))]
        assert groups == sorted(groups) and max(totals) <= 20
        assert all(a + b > 20 for a, b in zip(totals, totals[1:]) if min(a, b) < 8)


def test_short_stretches_share_frames():
    rows = pd.DataFrame([(f"p{i}", 0, c, "c", "l", 5) for i in range(3000) for c in range(2)], columns=["project_id", "run", "chunk", "chapter", "location", "n"])
    frames = list(clusters._fold(8, 20)([rows[:1001], rows[1001:1500], rows[1500:]]))
    assert len(frames) == 1
    made = pd.concat(frames)
    assert list(made["project_id"]) == list(rows["project_id"]) and list(made["chunk"]) == list(rows["chunk"]) and set(made["group"]) == {0}
    assert sum(map(len, clusters._fold(8, 20)([rows] * 5))) == 5 * len(rows)


def pause_rows(spark, rows):
    events = spark.createDataFrame([(1, lane, i, i, kind, code, prompt) for i, (lane, kind, code, prompt) in enumerate(rows)], "project_id long, lane long, event_id long, ts long, kind string, code long, prompt long")
    return [(r.lane, r.reason) for r in lanes.pauses(events).orderBy("event_id").collect()]


def test_lane_pauses(spark):
    assert pause_rows(spark, [(1, "fail", 0, None)] * 3 + [(2, "fail", 0, None)]) == [(1, "lane_failure_streak")]
    three = [(lane, "fail", 0, 5) for lane in (1, 2, 3)]
    assert pause_rows(spark, three) == [(3, "prompt_failure_streak")]
    assert pause_rows(spark, [*three, (3, "reopen", None, None), (4, "fail", 0, 5), (4, "fail", 0, 5)]) == [(3, "prompt_failure_streak")]
    assert pause_rows(spark, [(1, "fail", 0, None)] * 2 + [(1, "complete", None, None)] + [(1, "fail", 0, None)] * 2) == []
    assert pause_rows(spark, [(1, "fail", 0, None)] * 3 + [(1, "complete", None, None)] + [(1, "fail", 0, None)] * 3) == [(1, "lane_failure_streak")]


def test_legal_policies_pass(spark):
    rows = [(i, *p[:2], p[2] != "false", *p[3:]) for i, p in enumerate(rules.POLICIES)]
    df = spark.createDataFrame([*rows, (9, "edited", "visual", None, "reliable", "page", "visual_repair_requires_page_reset")], "k long, action string, repair_scope string, had_text boolean, recognition string, reset_mode string, reason string")
    assert [r.k for r in rules.illegal_policies(df, "k").collect()] == [9]


def test_streams_give_the_batch_rows(spark):
    batch = task_events(spark, FOLDER).withColumn("ts", F.col("ts").cast("timestamp")).select("lane", "ts", "kind", "event_id")
    stream = spark.readStream.schema(spark.read.parquet(f"{FOLDER}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(FOLDER)
    kinds = F.create_map(*(F.lit(x) for pair in (("signup", "add"), ("view", "claim"), ("purchase", "complete"), ("error", "fail"), ("click", "reopen")) for x in pair))
    events = stream.select(F.col("user_id").alias("lane"), F.col("ts").cast("timestamp").alias("ts"), kinds[F.col("event_type")].alias("kind"), "event_id")
    for name, made, mode in (("metrics", window_metrics(events), "complete"), ("adds", unique_adds(events), "append")):
        made.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.table("metrics").collect())) == sorted(map(tuple, window_metrics(batch).collect()))
    assert {r.lane for r in spark.table("adds").collect()} == {r.lane for r in lanes.first_adds(batch).collect()}
