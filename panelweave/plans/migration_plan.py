"""Queries over whole migration plans and bundles: documents as pages of projects, with their alignment and repair rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import migration_bundle as m
from panelweave.operators import migration_plan as plan
from panelweave.plans.migration import _SPELLED
from panelweave.operators.rules import CLASSES
from panelweave.registry import PAGES, registered
from panelweave.sources.shared import written
from panelweave.sources.tables import evidence_pages

_STATE = "case when lang is null then 'unresolved' when n_chars < 150 then 'provisional' else 'confirmed' end"
_KIND = lambda i, other: "case when st = 'unresolved' or blocked then '" + other + "' " + " ".join(f"when a in {names} then '{kind[i]}'" for kind, names in CLASSES.items()) + f" else '{other}' end"
_WHOLE = f"""{PAGES}, t as (select project_id, doc_id, pos, n, printf('%04d', pos) page, printf('%04d.jpg', pos) o, 'in/' || doc_id || '.jpg' path, sha256(doc_id || '') s, {_STATE} st, case when lang is null then '["unknown","unknown","unknown","unknown"]' else '["c' || ((pos - 1) // 30) || '","' || lang || '","' || case when n_chars < 1000 then 'day' else 'night' end || '","unknown"]' end k, replace(lower(trim({list(_SPELLED)}[doc_id % 8 + 1])), '-', '_') a from pg),
    u as (select *, case when st = 'unresolved' or coalesce(lag(st = 'unresolved') over w, true) or k is distinct from lag(k) over w then 1 else 0 end cut from t window w as (partition by project_id order by pos)),
    r as (select *, sum(cut) over (partition by project_id order by pos) run from u), h as (select *, (row_number() over (partition by project_id, run order by pos) - 1) // 20 chunk from r),
    c0 as (select project_id, run, chunk, count(*) size, min(pos) a_, max(pos) z_, any_value(n) n, any_value(k) k, ['confirmed', 'provisional', 'unresolved'][max(case st when 'unresolved' then 3 when 'provisional' then 2 else 1 end)] cs, string_agg('"' || o || '"', ',' order by pos) members from h group by 1, 2, 3),
    c1 as (select *, a_ + (size - 1) // 2 canary, size < 8 and n = size whole, 'cluster-' || substr(sha256('{{"alignment_state":"' || cs || '","member_pages":[' || members || '],"scene_key":' || k || '}}'), 1, 16) cid from c0), c as (select *, (size < 8 and not whole) or cs <> 'confirmed' blocked_ from c1),
    refs as (select c.project_id, cid, path, case when pos = canary then 'primary_style' else 'adjacent_style' end "role", s from c join t on t.project_id = c.project_id and (pos = canary or pos between a_ - 2 and a_ - 1 or pos between z_ + 1 and z_ + 2) union all select project_id, cid, 'sheets/' || project_id || '.png', 'identity_only', sha256(project_id) from c),
    rj as (select project_id, cid, '[' || string_agg('{{"path":"' || path || '","role":"' || "role" || '","sha256":"' || s || '"}}', ',' order by path, "role") || ']' j from refs group by 1, 2),
    pk as (select *, sha256('{{"cluster_id":"' || cid || '","references":' || j || '}}') pid from rj), pb as (select *, sha256('{{"reference_pack_id":"' || pid || '","references":' || j || '}}') bind from pk),
    w0 as (select h.*, c.cid, pid, bind, pos = canary is_canary, blocked_ and not whole blocked, size < 8 and not whole short from h join c using (project_id, run, chunk) join pb on pb.project_id = h.project_id and pb.cid = c.cid),
    w1 as (select *, {_KIND(0, 'evidence_blocked')} page_class, {_KIND(1, 'evidence_resolution')} task_type from w0),
    w2 as (select *, sha256('{{"cluster_id":"' || cid || '","page_class":"' || page_class || '","page_id":"' || o || '","reference_binding_hash":"' || bind || '","source_sha256":"' || s || '"}}') payload_hash from w1),
    w3 as (select *, sha256('{{"page_id":"' || page || '","payload_hash":"' || payload_hash || '","task_type":"' || task_type || '"}}') task_id from w2),
    whole as (select *, case when task_type = 'full_page_redraw' and not is_canary then max(case when is_canary then task_id end) over (partition by project_id, cid) end canary_task_id from w3)"""


def _planned(spark, sf_dir):
    # narrow, and read by several branches
    pages = written(evidence_pages(spark, sf_dir).select("project_id", "doc_id", "lang", "n_chars", F.col("pos").cast("int").alias("pos")))
    name = "format_string('%04d.jpg', pos)"
    inputs = pages.selectExpr("project_id", "pos `index`", "concat(doc_id, '.jpg') input_name", "concat('in/', doc_id, '.jpg') input_path", "sha2(cast(doc_id as string), 256) input_sha256", "doc_id")
    # a third of the rows is found by input name, a third by output name, a third by index
    keys = ("pos position", "if(doc_id % 3 = 0, concat(doc_id, '.jpg'), null) input_name", f"if(doc_id % 3 = 1, {name}, null) output_name", "if(doc_id % 3 = 2, pos, null) `index`")
    aligned = pages.filter("lang is not null").selectExpr("project_id", *keys, "if(n_chars < 150, ' Provisional', 'confirmed') status", "concat('c', cast(floor((pos - 1) / 30) as int)) chapter", "lang location", "if(n_chars < 1000, 'day', 'night') story_time", "' ' scene_id")
    log = pages.selectExpr("project_id", *keys, "'' page_class", f"element_at(array({', '.join(repr(x) for x in _SPELLED)}), cast(doc_id % 8 + 1 as int)) action")
    sheets = pages.select("project_id").distinct().selectExpr("project_id", "concat('sheets/', project_id, '.png') path", "sha2(project_id, 256) sha256")
    return plan.planned(inputs, aligned, log, sheets)


@registered("m4_whole_plans", f"""with {_WHOLE} select project_id, o output_name, st "state", cid cluster_id, pid reference_pack_id, page_class, task_type, payload_hash, task_id, is_canary, canary_task_id from whole""")
def m4_whole_plans(spark, sf_dir):
    return _planned(spark, sf_dir)[0].select("project_id", "output_name", "state", "cluster_id", "reference_pack_id", "page_class", "task_type", "payload_hash", "task_id", "is_canary", "canary_task_id")


@registered("m5_document_faults", f"""with {_WHOLE} select project_id, o entity, unnest(list_filter([case when doc_id % 11 = 0 then 'page_action_differs' end, case when doc_id % 13 = 0 then 'task_class_differs' end, case when doc_id % 17 = 0 then 'page_task_trace_invalid' end, case when doc_id % 19 = 0 and doc_id % 17 <> 0 then 'task_binding_differs' end, case when doc_id % 7 = 0 and short then 'blocked_page_released' end], lambda f: f is not null)) fault from whole""")
def m5_document_faults(spark, sf_dir):
    rows, clusters, packs = _planned(spark, sf_dir)
    rows = written(rows).withColumn("k", F.regexp_extract("input_name", r"^(\d+)", 1).cast("bigint"))
    documents = plan.proposed_documents(rows, clusters, packs)
    # the same plan with planted differences gives the documents that are at odds
    odd = rows.withColumn("action", F.expr("if(k % 11 = 0, 'redo', action)"))
    work = rows.withColumn("page_class", F.expr("if(k % 13 = 0, 'x', page_class)")).withColumn("reference_binding_hash", F.expr("if(k % 19 = 0, 'x', reference_binding_hash)")).withColumn("task_id", F.expr("if(k % 17 = 0, 'x', task_id)")).withColumn("task_type", F.expr("if(k % 7 = 0, 'visual', task_type)"))
    logs = written(plan.proposed_documents(odd, clusters, packs).filter(F.col("name") == m.REPAIR))
    queues = written(plan.proposed_documents(work, clusters, packs).filter(F.col("name") == m.QUEUE))
    sound = written(documents.filter(~F.col("name").isin(m.REPAIR, m.QUEUE)))
    return m.document_faults(sound.unionAll(logs).unionAll(queues))


_REGISTRY = "'scene_clusters.json'"


@registered("m10_applied_bundles", f"""with {PAGES}, d as (select project_id, pos, case when pos = 1 then {_REGISTRY} else printf('%04d', pos) end "name", '{{"doc":' || doc_id || ',"proposal_only":false' b from pg), e as (select *, case when pos = 1 then b || ',"registry_hash":"' || sha256(b || '}}') || '"}}' else b || '}}' end body from d),
    g as (select project_id, '{{' || string_agg('"' || "name" || '":"' || sha256(body) || '"', ',' order by "name") || '}}' j from e group by 1), i as (select *, sha256(project_id) src, sha256('{{"applied_hashes":' || j || ',"source_migration_id":"' || sha256(project_id) || '"}}') mid from g),
    c as (select *, sha256('{{"applied_hashes":' || j || ',"proposal_only":false,"source_confirmed_report_digest":"was","source_migration_id":"' || src || '"}}') dig from i)
    select project_id, mid migration_id, dig confirmed_report_digest, sha256('{{"applied_hashes":' || j || ',"confirmed_report_digest":"' || dig || '","migration_id":"' || mid || '","proposal_only":false,"source_confirmed_report_digest":"was","source_migration_id":"' || src || '"}}') report_integrity_hash from c""")
def m10_applied_bundles(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir)
    documents = pages.selectExpr("project_id", f"if(pos = 1, {_REGISTRY}, format_string('%04d', pos)) name", "concat('{\"proposal_only\":true, \"doc\":', doc_id, if(pos = 1, ',\"registry_hash\":\"stale\"', ''), '}') body")
    projects = pages.select("project_id").distinct()
    reports = projects.select("project_id", F.lit(m.REPORT).alias("name"), F.lit('{"proposal_only":true,"migration_id":"old","confirmed_report_digest":"was","report_integrity_hash":"stale"}').alias("body"))
    made, bundles = m.applied(documents.unionAll(reports), projects.selectExpr("project_id", "sha2(project_id, 256) source_id"))
    of = lambda field: F.get_json_object("body", f"$.{field}").alias(field)
    return made.filter(F.col("name") == m.REPORT).select("project_id", of("migration_id"), of("confirmed_report_digest"), of("report_integrity_hash"))
