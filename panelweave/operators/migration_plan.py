"""The migration plan in whole: pages with their alignment and repair rows, clusters, reference packs, classes, payload hashes, tasks and traces; and its documents.

Every step is keyed by the project, and its rows are dealt by project once: lookups and packs are
windows of (project, key), clusters are windows over a project's pages. A task's payload hash holds the cluster
and the binding of its pack, so it changes when either does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import content_hash
from panelweave.functions.text import page_id, sealed_json
from panelweave.operators import migration_bundle as m
from panelweave.operators.catalogue import CLUSTER_LEAST, EVIDENCE_FILES, MODE, RADIUS, SCHEMA, pack_ids
from panelweave.operators.clusters import SCENE, UNKNOWN, cluster_id, keyed
from panelweave.operators.migration import alignment_state
from panelweave.operators.rules import BLOCKED, with_task_class
from panelweave.sources.shared import dealt, written

P = "project_id"
CHUNK = 20


def _row_keys(rows: DataFrame, name: str, *fields: str) -> DataFrame:
    """A row for each key (by name, by index) that finds a row of a document, with the row under `name`."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    by = lambda kind, key: F.struct(F.lit(kind).alias("by"), key.alias("key"))
    names = F.transform(F.array_distinct(F.array_compact(F.array(blank("input_name"), blank("output_name")))), lambda x: by("name", x))
    placed = F.array_compact(F.array(F.when(F.col("index").isNotNull(), by("index", F.col("index").cast("int").cast("string")))))
    return rows.select(P, F.struct("position", *fields).alias(name), F.inline(F.concat(names, placed)))


def informed(inputs: DataFrame, alignment: DataFrame, log: DataFrame) -> DataFrame:
    """inputs (project_id, index, input_name, input_path, input_sha256) with output_name, state, the parts of the scene key, action, and ambiguous: a name or index that several rows claim.

    The row of a page is the one with its input name in either name field, else with its output
    name, else with its index. Pages and rows are dealt by project once and meet in a window of
    the project and key. alignment: also position, status, chapter, location, story_time,
    scene_id. log: also position, page_class, action.
    """
    pages = inputs.withColumn("output_name", F.format_string("%04d.jpg", "index"))
    asks = [("name", F.col("input_name")), ("name", F.col("output_name")), ("index", F.col("index").cast("int").cast("string"))]
    page, last = F.struct(*pages.columns), len(asks) - 1
    ask = lambda rank, by, key: F.struct(F.lit(rank).alias("rank"), F.lit(by).alias("by"), key.alias("key"), (page if rank == last else F.when(F.lit(False), page)).alias("page"))
    asked = pages.select(P, "index", F.inline(F.array(*(ask(rank, by, key) for rank, (by, key) in enumerate(asks)))))
    told = _row_keys(alignment, "a", "status", *SCENE)
    work = _row_keys(log.withColumn("action", F.coalesce(F.nullif("page_class", F.lit("")), "action")), "l", "action")
    rows = dealt(asked.unionByName(told, allowMissingColumns=True).unionByName(work, allowMissingColumns=True))
    same = Window.partitionBy(P, "by", "key")
    known = lambda c: F.when(F.col("key").isNotNull() & (F.count(c).over(same) > 0), F.struct("rank", F.count(c).over(same).alias("n"), F.min(c).over(same).alias("row")))
    rows = rows.select(P, "index", "page", known("a").alias("a"), known("l").alias("l"), F.col("rank").isNotNull().alias("asks")).filter("asks")
    # the first key that any row has decides; where several rows have it, none is taken
    met = rows.groupBy(P, "index").agg(F.max("page").alias("page"), F.min("a").alias("a"), F.min("l").alias("l"))
    row = lambda c: F.when(F.col(f"{c}.n") == 1, F.col(f"{c}.row"))
    ambiguous = lambda c: F.coalesce(F.col(f"{c}.n") > 1, F.lit(False))
    met = met.select("page.*", (ambiguous("a") | ambiguous("l")).alias("ambiguous"), row("a").alias("a"), row("l").alias("l")).select("*", "a.status", *(f"a.{c}" for c in SCENE), "l.action")
    rows = keyed(met).withColumn("state", alignment_state(F.col("status")))
    return rows.select(*inputs.columns, "output_name", "state", *SCENE, "action", "ambiguous")


def plan_clusters(pages: DataFrame) -> DataFrame:
    """Each page's cluster: runs of one scene in fixed chunks, an unresolved page by itself. A cluster that is too short or not confirmed is blocked; a short project may be one short cluster. near: the canary as primary style, and the pages just around the cluster as adjacent style."""
    story = Window.partitionBy(P).orderBy("index")
    key = F.concat_ws("\x1f", *SCENE)
    alone = F.col("state") == "unresolved"
    cut = alone | F.coalesce(F.lag(alone).over(story), F.lit(True)) | ~key.eqNullSafe(F.lag(key).over(story))
    page = F.struct(F.col("input_path").alias("path"), F.col("input_sha256").alias("sha256"))
    rows = dealt(pages.select(P, "index", "output_name", page.alias("page"), "state", *SCENE))
    rows = rows.withColumn("before", F.collect_list("page").over(story.rangeBetween(-RADIUS, -1))).withColumn("after", F.collect_list("page").over(story.rangeBetween(1, RADIUS)))
    runs = rows.withColumn("run", F.sum(cut.cast("int")).over(story)).withColumn("total", F.count("*").over(Window.partitionBy(P)))
    runs = runs.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(P, "run").orderBy("index")) - 1) / CHUNK))
    rank = F.when(alone, 2).when(F.col("state") == "provisional", 1).otherwise(0)
    ordered = F.array_sort(F.collect_list(F.struct("index", "output_name", "page")))
    made = runs.groupBy(P, "run", "chunk").agg(ordered.alias("pages"), F.max(rank).alias("rank"), F.min("index").alias("first"), F.max("index").alias("last"), F.first("total").alias("total"), F.min_by("before", "index").alias("before"), F.max_by("after", "index").alias("after"), *(F.first(c).alias(c) for c in SCENE))
    made = made.withColumn("member_pages", F.transform("pages", lambda x: x["output_name"])).withColumn("size", F.size("pages"))
    state = F.element_at(F.array(*map(F.lit, ("confirmed", "provisional", "unresolved"))), F.col("rank") + 1)
    short = F.col("size") < CLUSTER_LEAST
    whole = short & (F.col("total") == F.col("size"))
    codes = F.array_compact(F.array(F.when(short & ~whole, "UNDERSIZED_CLUSTER"), F.when(F.col("rank") == 2, "UNRESOLVED_ALIGNMENT").when(F.col("rank") == 1, "PROVISIONAL_ALIGNMENT")))
    made = made.withColumn("alignment_state", state).withColumn("scene_key", F.array(*SCENE)).withColumn("blocker_codes", codes)
    reference = lambda page, role: F.struct(page["path"].alias("path"), F.lit(role).alias("role"), page["sha256"].alias("sha256"))
    middle = F.floor((F.col("size") - 1) / 2).cast("int") + 1
    return made.select(
        P, "first", "last", "size", F.concat(F.array(reference(F.element_at("pages", middle)["page"], "primary_style")), F.transform(F.concat("before", "after"), lambda x: reference(x, "adjacent_style"))).alias("near"), "member_pages", "scene_key", "alignment_state", cluster_id(alignment_state=F.col("alignment_state"), member_pages=F.col("member_pages"), scene_key=F.col("scene_key")).alias("cluster_id"),
        F.element_at("member_pages", middle).alias("canary_page"), short.alias("undersized"), whole.alias("boundary_exception"), F.when(whole, "project_total_below_min").when(short, "scene_fragment_below_min").alias("undersized_reason"),
        (F.size("blocker_codes") > 0).alias("blocked"), "blocker_codes",
    )


def plan_packs(clusters: DataFrame, sheets: DataFrame) -> DataFrame:
    """project_id, cluster_id, reference_pack_id, reference_binding_hash and references: the canary and the pages around the cluster, and all identity sheets of the project. sheets: project_id, path, sha256."""
    identity = sheets.groupBy(P).agg(F.collect_list(F.struct("path", F.lit("identity_only").alias("role"), "sha256")).alias("identity"))
    packs = clusters.join(identity, P, "left").select(P, "cluster_id", F.concat("near", F.coalesce("identity", F.slice("near", 1, 0))).alias("references"))
    return pack_ids(packs).select(P, "cluster_id", F.col("content_id").alias("reference_pack_id"), F.col("content_binding").alias("reference_binding_hash"), F.col("canonical").alias("references"))


def planned(inputs: DataFrame, alignment: DataFrame, log: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan, clusters, packs). plan: a row for each page with its trace: cluster, pack, class, action, payload hash, task, and the canary task that a redraw waits for."""
    pages = written(informed(inputs, alignment, log))
    clusters = written(plan_clusters(pages))
    packs = written(plan_packs(clusters, sheets))
    # a cluster is a stretch of pages: it stands before its first page, and what follows is in it
    of_page = clusters.select(P, "cluster_id", "canary_page", "blocked", "boundary_exception", F.col("first").alias("index")).join(packs.select(P, "cluster_id", "reference_pack_id", "reference_binding_hash"), [P, "cluster_id"])
    of_page = of_page.select(P, "index", F.struct("cluster_id", "canary_page", "blocked", "boundary_exception", "reference_pack_id", "reference_binding_hash").alias("cluster"))
    rows = dealt(pages.unionByName(of_page, allowMissingColumns=True)).withColumn("cluster", F.last("cluster", ignorenulls=True).over(Window.partitionBy(P).orderBy("index", F.col("output_name").isNotNull())))
    rows = rows.filter("output_name is not null and cluster is not null").select(*pages.columns, "cluster.*")
    rows = with_task_class(rows.withColumn("unresolved", F.col("state") == "unresolved"))
    held = F.col("blocked") & ~F.col("boundary_exception")
    for at, name in enumerate(("page_class", "task_type")):
        rows = rows.withColumn(name, F.when(held, BLOCKED[at]).otherwise(F.col(name)))
    actions = F.create_map(*(F.lit(x) for pair in m.ACTIONS.items() for x in pair))
    payload = rows.select("*", F.col("output_name").alias("page_id"), F.col("input_sha256").alias("source_sha256")).withColumn("payload_hash", content_hash("page_id", "page_class", "source_sha256", "cluster_id", "reference_binding_hash"))
    tasks = payload.withColumn("page_id", page_id(F.col("output_name"))).withColumn("task_id", content_hash("page_id", "task_type", "payload_hash")).withColumn("is_canary", F.col("output_name") == F.col("canary_page"))
    tasks = tasks.withColumn("lead", F.max(F.when(F.col("is_canary"), F.col("task_id"))).over(Window.partitionBy(P, "cluster_id")))
    waits = (F.col("task_type") == "full_page_redraw") & ~F.col("is_canary")
    plan = tasks.select(
        P, "index", "input_name", "input_sha256", "output_name", "page_id", "state", "ambiguous", "cluster_id", "reference_pack_id", "reference_binding_hash", "page_class", actions[F.col("page_class")].alias("action"), "task_type", "payload_hash", "task_id", "is_canary",
        F.when(waits, F.col("lead")).alias("canary_task_id"),
    )
    return plan, clusters, packs


def proposed_documents(plan: DataFrame, clusters: DataFrame, packs: DataFrame) -> DataFrame:
    """project_id, name and body of the proposal's registries, manifest and repair log, registries with their hashes."""
    listed = lambda rows, order, *fields: F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("r")))), lambda x: x["r"])
    head = [F.lit(SCHEMA).alias("schema_version"), F.lit(True).alias("proposal_only")]
    declared = [*head, F.lit(MODE).alias("pipeline_mode"), F.array(*map(F.lit, EVIDENCE_FILES)).alias("evidence_files")]
    spelled = lambda name, rows, *fields: rows.select(P, F.lit(name).alias("name"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("body"))
    trace = ("output_name", "cluster_id", "reference_pack_id", "task_id", "page_class")
    pages = plan.groupBy(P).agg(listed(plan, "index", "input_name", "input_sha256", *trace).alias("pages"))
    log = plan.groupBy(P).agg(listed(plan, "index", *trace, "action").alias("pages"))
    work = plan.withColumn("prompt_reference_hash", F.col("reference_binding_hash")).groupBy(P).agg(listed(plan, "index", "task_id", "page_id", "task_type", "payload_hash", "cluster_id", "prompt_reference_hash", "page_class", "is_canary", "canary_task_id").alias("tasks"))
    bound = clusters.join(packs.select(P, "cluster_id", "reference_pack_id"), [P, "cluster_id"]).withColumn("reference_pack_state", F.lit("bound")).withColumn("source_pages", F.col("member_pages"))
    scene = bound.groupBy(P).agg(listed(bound, "first", "cluster_id", "member_pages", "source_pages", "scene_key", "alignment_state", "canary_page", "undersized", "boundary_exception", "undersized_reason", "blocked", "blocker_codes", "reference_pack_id", "reference_pack_state").alias("clusters"))
    qa = clusters.withColumn("status", F.lit("pending")).groupBy(P).agg(listed(clusters, "first", "cluster_id", "member_pages", "canary_page", "status").alias("clusters"))
    # references are dealt once, in their packs
    held = packs.groupBy(P).agg(listed(packs, "cluster_id", "reference_pack_id", "cluster_id", "references", "reference_binding_hash").alias("reference_packs"))
    flat = held.select(P, F.explode("reference_packs").alias("p")).select(P, F.explode("p.references").alias("r")).select(P, "r.*")
    style = flat.groupBy(P).agg(F.array_sort(F.collect_set(F.when(F.col("role") == "primary_style", F.col("path")))).alias("stable_pages"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("path", "sha256")))).alias("approved_hashes")).join(held, P)
    learning = plan.select(P).distinct().withColumn("rules", F.array().cast("array<string>"))
    made = [spelled(m.MANIFEST, pages, *declared, "pages"), spelled(m.REPAIR, log, *declared, "pages"), spelled(m.QUEUE, work, *head, "tasks"), spelled(m.SCENE, scene, *head, "clusters"), spelled(m.QA, qa, *head, "clusters"), spelled(m.STYLE, style, *head, "stable_pages", "approved_hashes", "reference_packs"), spelled(m.LEARNING, learning, *head, "rules")]
    return with_registry_hashes(m._all(*made))


def with_registry_hashes(documents: DataFrame) -> DataFrame:
    """The documents, registries with the hash of what they hold."""
    registry = F.col("name").isin(*m.REGISTRIES)
    return documents.withColumn("body", F.when(registry, sealed_json(F.when(registry, F.col("body")), "registry_hash")).otherwise(F.col("body")))
