"""Applied migration bundles in whole: seven documents and their report held against each other, against live alignment, and against what their ids and hashes say.

documents: project_id, name, body (JSON). A project has at most 9,999 pages, so a document is
one row; it is parsed once into typed rows, which joins and groupings of the project check.
Every finding is (project_id, entity, fault).
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from panelweave.functions.text import _canonical, edited_json, json_hash, normal_paths, page_id
from panelweave.operators.bundle import DIGEST, INTEGRITY, alignment_blockers, blocker, gate, report_faults
from panelweave.operators.migration import ACTIONS
from panelweave.operators.catalogue import CLUSTER_LEAST, CLUSTER_MOST, EVIDENCE_FILES, MODE, SCHEMA, pack_ids, page_name, sound_references
from panelweave.sources.shared import dealt, written

P = "project_id"
MANIFEST, REPAIR, METRICS, REPORT = "comic_run_manifest.json", "repair_log.json", "pipeline_metrics.json", "pipeline_migration_report.json"
SCENE, STYLE, QUEUE, LEARNING, QA = "scene_clusters.json", "style_reference_packs.json", "task_queue.json", "failure_learning.json", "scene_cluster_qa.json"
#: The registries of a bundle, the documents that it must hold, and those that a report hashes.
REGISTRIES = (SCENE, STYLE, QUEUE, LEARNING, QA)
NEEDED = (MANIFEST, REPAIR, *REGISTRIES)
HASHED = (*REGISTRIES, MANIFEST, REPAIR, METRICS)

_PAGE = "output_name:string,input_name:string,cluster_id:string,reference_pack_id:string,task_id:string,page_class:string,action:string"
_HEAD = "schema_version:string,pipeline_mode:string,evidence_files:array<string>"
SCHEMAS = {
    MANIFEST: f"struct<{_HEAD},pages:array<struct<{_PAGE}>>>", REPAIR: f"struct<{_HEAD},pages:array<struct<{_PAGE}>>>",
    SCENE: "struct<clusters:array<struct<cluster_id:string,member_pages:array<string>,source_pages:array<string>,undersized:boolean,boundary_exception:boolean,undersized_reason:string,blocked:boolean,blocker_codes:array<string>,alignment_state:string,reference_pack_id:string,reference_pack_state:string>>>",
    STYLE: "struct<stable_pages:array<string>,approved_hashes:map<string,string>,reference_packs:array<struct<reference_pack_id:string,cluster_id:string,references:array<struct<path:string,role:string,sha256:string>>,reference_binding_hash:string>>>",
    QUEUE: "struct<tasks:array<struct<task_id:string,page_id:string,task_type:string,cluster_id:string,prompt_reference_hash:string,page_class:string>>>",
    LEARNING: "struct<revision:bigint>", QA: "struct<clusters:array<struct<cluster_id:string>>>",
    REPORT: "struct<applied_hashes:map<string,string>,source_migration_id:string,ready_for_migration:boolean,exact_bijection_planned:boolean>",
}
LISTS = {MANIFEST: "pages", REPAIR: "pages", SCENE: "clusters", STYLE: "reference_packs", QUEUE: "tasks", QA: "clusters"}


def _faults(rows: DataFrame, entity, **ok: Column) -> DataFrame:
    """(project_id, entity, fault) for each condition that a row does not meet; null does not meet one."""
    wrong = F.array_compact(F.array(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in ok.items())))
    return rows.select(P, (F.col(entity) if isinstance(entity, str) else entity).cast("string").alias("entity"), F.explode(wrong).alias("fault"))


def _parsed(documents: DataFrame, name: str) -> DataFrame:
    return documents.filter(F.col("name") == name).select(P, F.from_json("body", SCHEMAS[name]).alias("d"))


def _rows(documents: DataFrame, name: str) -> DataFrame:
    """The members of a document's list, each with at, its place from 0."""
    return _parsed(documents, name).select(P, F.posexplode(f"d.{LISTS[name]}").alias("at", "r")).select(P, "at", "r.*")


def _all(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def _found(entity: Column, **ok: Column) -> Column:
    """The (entity, fault) of a row as an array, for each condition that it does not meet; null does not meet one."""
    wrong = (F.when(~F.coalesce(good, F.lit(False)), F.struct(entity.cast("string").alias("entity"), F.lit(name).alias("fault"))) for name, good in ok.items())
    return F.array_compact(F.array(*wrong))


def _last(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """One row for each key of a project, the last in the document."""
    return rows.filter(F.col(key).isNotNull()).groupBy(P, key).agg(F.max_by(F.struct(*fields), "at").alias("r")).select(P, key, "r.*")


def head_faults(documents: DataFrame) -> DataFrame:
    """Documents that a bundle lacks, registries whose recorded hash is not theirs, declarations of another schema, and collections that are no lists."""
    held = documents.groupBy(P).agg(F.collect_set("name").alias("names"))
    missing = held.select(P, F.explode(F.array_except(F.array(*map(F.lit, NEEDED)), F.col("names"))).alias("entity"), F.lit("document_missing").alias("fault"))
    name, parsed = F.col("name"), {n: F.from_json("body", SCHEMAS[n]) for n in LISTS}
    recorded = F.get_json_object("body", "$.registry_hash")
    hashed = ~name.isin(*REGISTRIES) | (recorded == json_hash(F.when(name.isin(*REGISTRIES), F.col("body")), "registry_hash"))
    # all conditions in one pass over the documents
    declared, listed = F.lit(True), F.lit(True)
    for n in (MANIFEST, REPAIR):
        d = parsed[n]
        declared = F.when(name == n, (d["schema_version"] == SCHEMA) & (d["pipeline_mode"] == MODE) & (d["evidence_files"] == F.array(*map(F.lit, EVIDENCE_FILES)))).otherwise(declared)
    for n, field in LISTS.items():
        listed = F.when(name == n, parsed[n][field].isNotNull()).otherwise(listed)
    return missing.unionByName(_faults(documents, "name", registry_hash_differs=hashed, declaration_invalid=declared, collection_missing=listed))


def _name_faults(manifest: DataFrame) -> DataFrame:
    """Manifests whose pages are not named once each, and in order. An empty list has no fault."""
    pages = F.col("d.pages")
    distinct = lambda field: F.size(F.array_distinct(F.array_compact(F.transform(pages, lambda r: r[field]))))
    ordered = F.forall(F.transform(pages, lambda r, i: r["output_name"] == page_name(i + 1)), lambda x: x)
    n = F.size(pages)
    return _faults(manifest, F.lit(MANIFEST), names_no_bijection=(n == 0) | ((distinct("output_name") == n) & (distinct("input_name") == n) & ordered))


def _cluster_faults(story: DataFrame, clusters: DataFrame) -> DataFrame:
    """The clusters with what is found in each (found), whether they count (good: one of each id) and whether they are short and no exception. story: project_id, outputs."""
    # only a project that is too short for a cluster is compared with one as a whole
    whole_story = story.select(P, F.size("outputs").alias("total"), F.when(F.size("outputs") < CLUSTER_LEAST, F.col("outputs")).alias("outputs"))
    first = F.row_number().over(Window.partitionBy(P, "cluster_id").orderBy("at")) == 1
    rows = dealt(clusters).withColumn("fits", F.col("cluster_id").isNotNull() & F.col("member_pages").isNotNull() & F.col("source_pages").isNotNull() & first)
    rows = rows.join(dealt(whole_story), P, "left").withColumn("good", F.col("fits") & F.col("total").isNotNull()).withColumn("n", F.size("member_pages"))
    identity = _found(F.col("at"), cluster_identity_invalid=F.col("cluster_id").isNotNull(), cluster_membership_invalid=F.col("cluster_id").isNull() | F.col("fits"))
    small, exception = F.col("undersized"), F.coalesce(F.col("boundary_exception"), F.lit(False))
    sized = small.isNotNull() & (small == (F.col("n") < CLUSTER_LEAST)) & (F.col("n") <= CLUSTER_MOST)
    sized = F.coalesce(sized, F.lit(False))
    whole = (F.col("total") < CLUSTER_LEAST) & (F.col("member_pages") == F.col("outputs")) & F.col("undersized_reason").eqNullSafe("project_total_below_min")
    held = F.col("boundary_exception").eqNullSafe(F.lit(False)) & F.col("blocked").eqNullSafe(F.lit(True)) & F.col("undersized_reason").eqNullSafe("scene_fragment_below_min") & F.coalesce(F.array_contains("blocker_codes", "UNDERSIZED_CLUSTER"), F.lit(False))
    plain = F.col("boundary_exception").eqNullSafe(F.lit(False)) & F.col("undersized_reason").isNull()
    states = _found(F.col("cluster_id"), cluster_size_invalid=sized, boundary_exception_invalid=~sized | ~(small & exception) | whole, short_cluster_not_blocked=~sized | ~(small & ~exception) | held, full_cluster_marked=~sized | small | plain)
    found = F.concat(identity, F.when(F.col("good"), states).otherwise(F.slice(states, 1, 0)))
    return rows.select(P, "at", "cluster_id", "member_pages", "reference_pack_id", "reference_pack_state", found.alias("found"), "good", F.coalesce(F.col("good") & sized & small & ~exception, F.lit(False)).alias("short"))


def _pack_faults(style: DataFrame, packs: DataFrame) -> DataFrame:
    """The packs with what is found in each (found), and whether they are sound.

    What a pack asks of its registry (is a path stable, which hash is approved) and what the
    registry says meet in one window of the project and path.
    """
    none = F.lit(None)
    whole = F.col("reference_pack_id").isNotNull() & F.col("cluster_id").isNotNull() & F.col("references").isNotNull()
    rows = pack_ids(packs).withColumn("whole", whole)
    hashed = F.forall("references", lambda r: r["sha256"].isNull() | r["sha256"].rlike("^[0-9a-fA-F]{64}$"))
    fit = F.col("whole") & hashed & sound_references(F.transform("canonical", lambda r: r["path"]))
    same = (F.col("reference_pack_id") == F.col("content_id")) & (F.col("references") == F.col("canonical")) & (F.col("reference_binding_hash") == F.col("content_binding"))
    pack = F.struct("reference_pack_id", "cluster_id", "content_binding", "whole", F.coalesce(fit, F.lit(False)).alias("fit"), F.coalesce(same, F.lit(False)).alias("same"))
    ask = lambda kind, path, sha, pack: F.struct(F.lit(kind).alias("kind"), path.cast("string").alias("path"), sha.cast("string").alias("sha256"), pack.alias("pack"))
    nothing = F.when(F.lit(False), pack)
    itself = F.array(ask("pack", none, none, pack))
    asks = F.concat(itself, F.transform("references", lambda r: ask("approved", r["path"], r["sha256"], nothing)), F.transform(F.filter("canonical", lambda r: r["role"] == "primary_style"), lambda r: ask("stable", r["path"], none, nothing)))
    asked = rows.select(P, "at", F.inline(F.when(F.col("whole"), asks).otherwise(itself)), none.cast("int").alias("place"))
    says = lambda kind, rows: rows.select(P, none.cast("int").alias("at"), F.lit(kind).alias("kind"), "path", F.col("sha256").cast("string").alias("sha256"), none.cast(asked.schema["pack"].dataType).alias("pack"), "place")
    approved = says("approved", style.select(P, F.posexplode("d.approved_hashes").alias("place", "path", "sha256")))
    stable = says("stable", style.select(P, none.alias("sha256"), F.posexplode(normal_paths("d.stable_pages")).alias("place", "path")))
    met = dealt(_all(asked, approved, stable)).withColumn("said", F.min(F.when(F.col("place").isNotNull(), F.struct("place", "sha256"))).over(Window.partitionBy(P, "kind", "path")))
    right = F.when(F.col("kind") == "approved", F.col("sha256").eqNullSafe(F.col("said.sha256"))).when(F.col("kind") == "stable", F.col("said").isNotNull())
    of = lambda kind: F.coalesce(F.min(F.when(F.col("kind") == kind, right)), F.lit(True)).alias(kind)
    rows = met.filter(F.col("at").isNotNull()).groupBy(P, "at").agg(F.max(F.when(F.col("kind") == "pack", F.col("pack"))).alias("pack"), of("stable"), of("approved")).select(P, "at", "pack.*", "stable", "approved")
    rows = rows.withColumn("sound", F.col("fit") & F.col("stable"))
    content = _found(F.col("reference_pack_id"), pack_invalid=F.col("sound"), pack_content_differs=~F.col("sound") | F.col("same"), pack_hash_not_approved=~F.col("sound") | F.col("approved"))
    found = F.concat(_found(F.col("at"), pack_identity_invalid=F.col("whole")), F.when(F.col("whole"), content).otherwise(F.slice(content, 1, 0)))
    return rows.select(P, "at", "reference_pack_id", F.col("cluster_id").alias("owner"), F.col("content_binding").alias("binding"), "sound", found.alias("found"))


def _page_faults(pages: DataFrame, repair: DataFrame, clusters: DataFrame, tasks: DataFrame) -> DataFrame:
    """What the pages of manifest and repair log say of their cluster, pack, task, class and action, and members of clusters and tasks that repeat.

    Pages, log, members and tasks are dealt by project once; those of one name meet in a window
    of the project and name, those of one page id in a window of the project and page id.
    """
    page = ("cluster_id", "reference_pack_id", "task_id", "page_class")
    kind = lambda k: F.lit(k).alias("kind")
    told = pages.select(P, kind("page"), "at", "output_name", page_id(F.col("output_name")).alias("page_id"), *page)
    log = repair.filter(F.col("output_name").isNotNull()).select(P, kind("log"), "at", "output_name", *page, "action")
    member = clusters.select(P, kind("member"), "at", "cluster_id", "reference_pack_id", "binding", "short", F.posexplode("member_pages").alias("place", "output_name"))
    task = tasks.select(P, kind("task"), "at", "page_id", "task_id", "task_type", "cluster_id", F.col("prompt_reference_hash").alias("binding"), "page_class")
    more = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    rows = dealt(reduce(more, (told, log, member, task)))
    of = lambda k, *fields: F.when(F.col("kind") == k, F.struct(*fields))
    by_name, by_page = Window.partitionBy(P, "output_name"), Window.partitionBy(P, "page_id")
    known = lambda key, found: F.when(F.col(key).isNotNull(), found)
    rows = rows.withColumn("r", known("output_name", F.max(of("log", "at", *page, "action")).over(by_name))).withColumn("m", known("output_name", F.max(of("member", "at", "cluster_id", "reference_pack_id", "binding")).over(by_name)))
    rows = rows.withColumn("in_short", F.coalesce(known("output_name", F.max(F.when(F.col("kind") == "member", F.col("short"))).over(by_name)), F.lit(False))).withColumn("first_member", F.min(of("member", "at", "place")).over(by_name))
    # log and members have done their part; only members that repeat go on
    rows = rows.filter(F.col("kind").isin("page", "task") | ((F.col("kind") == "member") & (F.struct("at", "place") != F.col("first_member")))).drop("first_member")
    rows = rows.withColumn("t", known("page_id", F.max(of("task", "at", "task_id", "task_type", "cluster_id", "binding", "page_class")).over(by_page))).withColumn("paged", F.max(F.col("kind") == "page").over(by_page)).withColumn("first_task", F.min(F.when(F.col("kind") == "task", F.col("at"))).over(by_page))
    there = F.col("output_name").isNotNull() & F.col("r").isNotNull()
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    tasked = F.col("t").isNotNull() & same("t.task_id", "task_id")
    actions = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    classed = F.coalesce(F.col("page_class").isin(*ACTIONS) & same("page_class", "r.page_class"), F.lit(False))
    blocked = (F.col("page_class") == "evidence_blocked") & (F.col("t.task_type") == "evidence_resolution")
    traces = [_found(F.concat_ws(" ", "output_name", F.lit(f)), trace_differs=same(f, f"r.{f}")) for f in ("cluster_id", "reference_pack_id", "task_id")]
    each = _found(
        F.col("output_name"), page_cluster_trace_invalid=same("cluster_id", "m.cluster_id") & same("reference_pack_id", "m.reference_pack_id"), page_task_trace_invalid=tasked, task_binding_differs=~tasked | (same("t.cluster_id", "m.cluster_id") & same("t.binding", "m.binding")),
        page_class_differs=classed, page_action_differs=~classed | F.col("r.action").eqNullSafe(actions[F.col("page_class")]), task_class_differs=F.col("t").isNull() | same("t.page_class", "page_class"), blocked_page_released=~F.col("in_short") | blocked,
    )
    of_page = F.when(there, F.concat(*traces, each)).otherwise(_found(F.col("at"), page_mapping_invalid=there))
    of_page = F.concat(of_page, _found(F.lit(QUEUE), tasks_no_bijection=F.col("t").isNotNull()))
    of_task = F.concat(_found(F.col("at"), task_identity_invalid=F.col("page_id").isNotNull(), task_page_repeated=F.col("page_id").isNull() | (F.col("at") == F.col("first_task"))), _found(F.lit(QUEUE), tasks_no_bijection=F.col("page_id").isNull() | F.col("paged")))
    again = _found(F.col("output_name"), cluster_page_repeated=F.lit(False))
    return rows.select(P, F.inline(F.when(F.col("kind") == "page", of_page).when(F.col("kind") == "task", of_task).otherwise(again)))


def document_faults(documents: DataFrame) -> DataFrame:
    """Findings in the seven documents of a bundle; projects whose documents are missing, of another schema or wrongly hashed have those findings only."""
    head = written(head_faults(documents))
    fine = documents.join(head.select(P).distinct(), P, "left_anti")
    found = lambda rows: rows.select(P, F.inline("found"))
    # the manifest and the clusters are read by several groups: parsed once; findings are written group by group, as one plan of all groups would be too large for the driver
    manifest = written(_parsed(fine, MANIFEST))
    story = manifest.select(P, F.transform("d.pages", lambda r: r["output_name"]).alias("outputs")).filter(F.size("outputs") > 0)
    clusters = written(_cluster_faults(story, _rows(fine, SCENE)))
    good = clusters.filter("good")
    walked = good.groupBy(P).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "member_pages"))), lambda x: x["member_pages"])).alias("walked"))
    order = _faults(story.join(walked, P, "left"), F.lit(SCENE), clusters_no_bijection=F.col("walked") == F.col("outputs"))
    style = _parsed(fine, STYLE)
    packs = written(_pack_faults(style, _rows(fine, STYLE)))
    of_registry = _faults(style, F.lit(STYLE), style_registry_invalid=F.col("d.stable_pages").isNotNull() & F.col("d.approved_hashes").isNotNull())
    held = _last(packs.filter("sound"), "reference_pack_id", "owner", "binding")
    bound = written(good.join(held, [P, "reference_pack_id"], "left"))
    of_bound = _faults(bound, "cluster_id", cluster_pack_unbound=(F.col("owner") == F.col("cluster_id")) & (F.col("reference_pack_state") == "bound"))
    pages = manifest.select(P, F.posexplode("d.pages").alias("at", "r")).select(P, "at", "r.*")
    of_pages = written(_page_faults(pages, _rows(fine, REPAIR), bound, _rows(fine, QUEUE)))
    # every page or task that stands alone tells of the same missing bijection
    once = F.col("fault") == "tasks_no_bijection"
    seen = _parsed(fine, QA).select(P, F.transform("d.clusters", lambda x: x["cluster_id"]).alias("seen"))
    wanted = good.groupBy(P).agg(F.array_sort(F.collect_set("cluster_id")).alias("wanted"))
    qa = _faults(seen.join(wanted, P, "left"), F.lit(QA), cluster_qa_no_bijection=F.array_sort("seen") == F.coalesce("wanted", F.array().cast("array<string>")))
    return _all(head, _name_faults(manifest), found(clusters), order, of_registry, found(packs), of_bound, of_pages.filter(~once), of_pages.filter(once).distinct(), qa)


def live_gate(documents: DataFrame, faults: DataFrame, alignment: DataFrame, blockers: list[DataFrame]) -> DataFrame:
    """project_id, blockers, exact_bijection and ready, derived from live evidence and the registries, never from the report. alignment: project_id, output_name, page, state; blockers: (project_id, blocker) of other evidence."""
    pages, clusters = _rows(documents, MANIFEST), _rows(documents, SCENE)
    members = clusters.select(P, F.col("alignment_state").alias("cluster_state"), (F.coalesce("blocked", F.lit(False)) | (F.coalesce(F.size("blocker_codes"), F.lit(0)) > 0)).alias("cluster_blocked"), F.explode("member_pages").alias("output_name"))
    told = pages.select(P, "output_name").join(alignment, [P, "output_name"], "left").select(P, "output_name", F.coalesce("page", "output_name").alias("page"), F.coalesce("state", F.lit("unresolved")).alias("state"))
    rows = told.join(members, [P, "output_name"], "left").withColumn("cluster_state", F.coalesce("cluster_state", "state")).withColumn("cluster_blocked", F.coalesce("cluster_blocked", F.lit(True)))
    wrong = faults.select(P, blocker("BUNDLE_VALIDATION_ERROR").alias("blocker"))
    exact = documents.select(P).distinct().join(pages.select(P).distinct().withColumn("some", F.lit(True)), P, "left").join(faults.select(P).distinct().withColumn("bad", F.lit(True)), P, "left")
    return gate(documents, [alignment_blockers(rows), wrong, *blockers], exact.select(P, (F.col("some").isNotNull() & F.col("bad").isNull()).alias("exact")))


@F.pandas_udf(StringType())
def _bare_blockers(body: pd.Series) -> pd.Series:
    """The blockers of a report without their details, in canonical order; null if they are no list of objects."""

    def spell(x: str) -> str | None:
        try:
            held = json.loads(x).get("blockers")
        except (ValueError, AttributeError):
            return None
        if not isinstance(held, list) or not all(isinstance(m, dict) for m in held):
            return None
        return "[" + ",".join(sorted(_canonical({k: v for k, v in m.items() if k != "detail"}) for m in held)) + "]"

    return pd.Series([None if x is None else spell(x) for x in body], dtype=object)


@F.pandas_udf(StringType())
def source_identity(body: pd.Series) -> pd.Series:
    """The id of the migration that a report was applied from, from what the report says of its sources, snapshots, proposals and gate."""
    took = {"locked_sources": ("locked_sources_before", {}), "output_snapshot": ("output_snapshot_before", []), "image_snapshot": ("image_snapshot_before", []), "proposal_hashes": ("proposal_hashes", {}), "ready_for_migration": ("ready_for_migration", None), "exact_bijection_planned": ("exact_bijection_planned", None), "confirmed_report_digest": ("source_confirmed_report_digest", "")}

    def spell(x: str) -> str | None:
        try:
            report = json.loads(x)
            made = {name: report.get(field, other) for name, (field, other) in took.items()}
            made |= {"schema_version": SCHEMA, "blockers": sorted(report.get("blockers", []), key=_canonical)}
            return hashlib.sha256(_canonical(made).encode()).hexdigest()
        except (ValueError, AttributeError, TypeError):
            return None

    return pd.Series([None if x is None else spell(x) for x in body], dtype=object)


def bundle_faults(documents: DataFrame, alignment: DataFrame, blockers: list[DataFrame] = ()) -> DataFrame:
    """Findings in whole applied bundles: in their documents, in the report's own hashes, in the hashes of what was applied, in the gate (derived anew and compared), and in the id of the source migration."""
    found = written(document_faults(documents))
    report = documents.filter(F.col("name") == REPORT).select(P, "body", F.from_json("body", SCHEMAS[REPORT]).alias("d"))
    lost = documents.select(P).distinct().join(report.select(P), P, "left_anti").select(P, F.lit(REPORT).alias("entity"), F.lit("document_missing").alias("fault"))
    seals = report_faults(report.select(P, "body"), P).select(P, F.lit(REPORT).alias("entity"), "fault")
    made = documents.filter(F.col("name").isin(*HASHED)).select(P, "name", json_hash(F.col("body")).alias("hash"))
    said = report.select(P, F.explode("d.applied_hashes").alias("name", "said"))
    apart = made.join(said, [P, "name"], "full_outer").filter(~F.col("hash").eqNullSafe(F.col("said"))).select(P).distinct().withColumn("apart", F.lit(True))
    live = live_gate(documents, found, alignment, list(blockers))
    listed = F.concat(F.lit("["), F.array_join("blockers", ","), F.lit("]"))
    rows = report.join(apart, P, "left").join(live.select(P, listed.alias("derived"), "ready", "exact_bijection"), P, "left")
    rows = rows.withColumn("reported", _bare_blockers("body")).withColumn("source_id", source_identity("body"))
    named = F.col("d.source_migration_id").isNotNull()
    alike = F.coalesce((F.col("reported") == F.col("derived")) & (F.col("d.ready_for_migration") == F.col("ready")) & (F.col("d.exact_bijection_planned") == F.col("exact_bijection")), F.lit(False))
    of_report = _faults(rows, F.lit(REPORT), applied_hashes_differ=F.col("apart").isNull(), source_id_missing=named, gate_differs=~named | alike, source_id_differs=~named | ~alike | (F.col("d.source_migration_id") == F.col("source_id")))
    return _all(found, lost, seals, of_report)


def applied(documents: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, bundles): proposals as applied documents, and each project's migration_id and applied_hashes. sources: project_id, source_id.

    From the inside out: a document is no proposal any more; a registry then names its new
    hash; the report names all applied hashes and the id made of them and of the source's,
    then its digest, and last the seal over all of it. Every document is spelled canonically.
    """
    flipped = edited_json("body", F.lit('{"proposal_only":false}'))
    others = documents.filter(F.col("name") != REPORT).select(P, "name", flipped.alias("body"))
    named = F.to_json(F.struct(json_hash(F.col("body"), "registry_hash").alias("registry_hash")))
    others = written(others.withColumn("body", F.when(F.col("name").isin(*REGISTRIES), edited_json("body", named)).otherwise(F.col("body"))))
    listed = F.array_sort(F.collect_list(F.struct("name", F.sha2("body", 256).alias("hash"))))
    bundles = others.groupBy(P).agg(F.map_from_entries(listed).alias("applied_hashes")).join(sources, P)
    bundles = bundles.withColumn("migration_id", F.sha2(F.to_json(F.struct("applied_hashes", F.col("source_id").alias("source_migration_id"))), 256))
    reports = documents.filter(F.col("name") == REPORT).join(bundles, P)
    more = F.struct("applied_hashes", "migration_id", F.lit(False).alias("proposal_only"), F.get_json_object("body", "$.confirmed_report_digest").alias("source_confirmed_report_digest"), F.col("source_id").alias("source_migration_id"))
    told = reports.select(P, "name", edited_json("body", F.to_json(more)).alias("body"))
    told = told.withColumn("body", edited_json("body", F.to_json(F.struct(json_hash(F.col("body"), *DIGEST).alias("confirmed_report_digest")))))
    told = told.withColumn("body", edited_json("body", F.to_json(F.struct(json_hash(F.col("body"), *INTEGRITY).alias("report_integrity_hash")))))
    return others.unionByName(told), bundles.select(P, "applied_hashes", "source_id", "migration_id")
