"""Scene clusters: balanced chunks whose short ones are merged, and the fixed chunks of the migration plan.

Merging is a fold over the chunks of a stretch (one chapter and location), in story order. It
runs over sorted partitions and holds the chunks of one stretch, never their pages.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import balanced_group
from panelweave.functions.text import nfkc, trimmed
from panelweave.operators.sequence import CHUNK, RADIUS, placed, scene_runs, with_context
from panelweave.sources.shared import dealt, written

LEAST = 8
UNKNOWN = "unknown"
SCENE = ("chapter", "location", "story_time", "scene_id")


def scene_keyed(pages: DataFrame) -> DataFrame:
    """The parts of the scene key in NFKC, without white space at their ends; blank or missing ones become `unknown`."""
    return pages.withColumns({c: F.coalesce(trimmed(nfkc(c)), F.lit(UNKNOWN)) for c in SCENE})


def keyed(pages: DataFrame) -> DataFrame:
    """As in migration, without NFKC: blank or missing parts of the scene key become `unknown`."""
    return pages.withColumns({c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(UNKNOWN)) for c in SCENE})


def cluster_id(**payload: Column) -> Column:
    """The content id of a cluster: the first 16 digits of the hash of the canonical JSON of its ordered members and scene key (and state, in migration)."""
    return F.concat(F.lit("cluster-"), F.substring(F.sha2(F.to_json(F.struct(*(value.alias(name) for name, value in sorted(payload.items())))), 256), 1, 16))


def merged_groups(sizes: list[int], least: int, most: int) -> list[int]:
    """The group of each chunk: a chunk below `least` joins the group before it, else the chunk after it, where both fit into `most`."""
    done: list[tuple[int, int]] = []
    ahead = deque((size, 1) for size in sizes)
    while ahead:
        size, chunks = ahead.popleft()
        if size >= least:
            done.append((size, chunks))
        elif done and done[-1][0] + size <= most:
            before = done.pop()
            ahead.appendleft((before[0] + size, before[1] + chunks))
        elif ahead and size + ahead[0][0] <= most:
            after = ahead.popleft()
            ahead.appendleft((size + after[0], chunks + after[1]))
        else:
            done.append((size, chunks))
    return [group for group, (_, chunks) in enumerate(done) for _ in range(chunks)]


#: rows that a frame of groups holds at least, but for the last
FRAME = 8192


def _fold(least: int, most: int):
    def stretch(rows: list[tuple]) -> list[tuple]:
        loose = UNKNOWN in rows[0][3:5]
        groups = range(len(rows)) if loose else merged_groups([r[5] for r in rows], least, most)
        return [(*r[:3], rows[0][1], group) for r, group in zip(rows, groups)]

    def work(frames):
        frame = lambda made: pd.DataFrame(made, columns=["project_id", "run", "chunk", "first_run", "group"])
        held: list[tuple] = []
        made: list[tuple] = []
        for rows in frames:
            for row in rows.itertuples(index=False, name=None):
                if held and (held[-1][0], *held[-1][3:5]) != (row[0], *row[3:5]):
                    made += stretch(held)
                    held = []
                held.append(row)
            # stretches are short: a frame each would cost more than the merging
            if len(made) >= FRAME:
                yield frame(made)
                made = []
        if held:
            made += stretch(held)
        if made:
            yield frame(made)

    return work


def scene_clusters(pages: DataFrame, least: int = LEAST, most: int = CHUNK, radius: int = RADIUS) -> DataFrame:
    """One row a cluster: members, context, scene key, canary, content id and size controls.

    The canary is the page of highest risk, ties by story order; without any risk the lower
    middle page. A short cluster is blocked, unless it is the whole of a short project.
    """
    project = "coalesce(project_id, '')"
    run = Window.partitionBy("project_id", "run")
    paged = scene_runs(scene_keyed(pages)).withColumn("at", F.row_number().over(run.orderBy("pos")) - 1).withColumn("n", F.count("*").over(run))
    paged = paged.withColumn("chunk", balanced_group(F.col("at"), F.col("n"), most)).withColumn("project_id", F.expr(project))
    chunks = paged.groupBy("project_id", "run", "chunk", "chapter", "location").agg(F.count("*").alias("n"))
    told = dealt(chunks).sortWithinPartitions("project_id", "run", "chunk")
    groups = told.mapInPandas(_fold(least, most), "project_id string, run bigint, chunk bigint, first_run bigint, group bigint")
    # both the context and the facts of a cluster read these narrow rows
    named = written(paged.join(groups, ["project_id", "run", "chunk"]).withColumn("cluster", F.struct("first_run", "group")))
    made = with_context(named, "cluster", radius)
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise("mixed")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "page_id")))
    middle = F.element_at(ordered, F.floor((F.count("*") - 1) / 2).cast("int") + 1)["page_id"]
    worst = F.max_by(F.when(F.col("risk").isNotNull(), F.col("page_id")), F.when(F.col("risk").isNotNull(), F.struct("risk", -F.col("pos"))))
    # where the scene is mixed, so are both of its parts
    same = F.countDistinct("story_time", "scene_id") == 1
    facts = named.groupBy("project_id", "cluster").agg(
        F.min("pos").alias("first_pos"), F.first("total").alias("total"), one("chapter").alias("chapter"), one("location").alias("location"),
        F.when(same, F.min("story_time")).otherwise("mixed").alias("story_time"), F.when(same, F.min("scene_id")).otherwise("mixed").alias("scene_id"), F.coalesce(worst, middle).alias("canary"),
    )
    joined = made.join(facts, ["project_id", "cluster"]).withColumn("number", F.row_number().over(Window.partitionBy("project_id").orderBy("first_pos")).cast("bigint"))
    small = F.col("size") < least
    whole = small & (F.col("total") == F.col("size"))
    return joined.select(
        "project_id", F.col("number").alias("cluster"), "size", "members", "before", "after", *SCENE, "canary",
        cluster_id(member_pages=F.split("members", ","), scene_key=F.array(*SCENE)).alias("cluster_id"),
        F.when(whole, "project_total_below_min").when(small, "scene_fragment_below_min").alias("undersized_reason"), (small & ~whole).alias("blocked"),
    )


def migration_clusters(pages: DataFrame, most: int = CHUNK) -> DataFrame:
    """Fixed chunks of the scene runs without merging; an unresolved page stands alone. pages have unresolved; the canary is the middle page."""
    order = Window.partitionBy("project_id").orderBy("pos")
    key = F.concat_ws("\x1f", *SCENE)
    alone = F.col("unresolved") | F.coalesce(F.lag("unresolved").over(order), F.lit(True))
    turned = placed(keyed(pages)).withColumn("key", key).withColumn("turn", (alone | ~F.col("key").eqNullSafe(F.lag("key").over(order))).cast("bigint"))
    runs = turned.withColumn("run", F.sum("turn").over(order))
    spots = runs.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("project_id", "run").orderBy("pos")) - 1) / most))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "page_id")))
    state = F.when(F.max("unresolved"), "unresolved").otherwise("confirmed")
    named = cluster_id(alignment_state=state, member_pages=F.transform(ordered, lambda x: x["page_id"].cast("string")), scene_key=F.array(*(F.first(c) for c in SCENE)))
    return spots.groupBy("project_id", "run", "chunk").agg(
        F.count("*").alias("size"), named.alias("cluster_id"), F.min_by("page_id", "pos").alias("first_page"), F.element_at(ordered, F.floor((F.count("*") - 1) / 2).cast("int") + 1)["page_id"].alias("canary"),
        state.alias("state"),
    )
