"""Queries of the rule catalogue: documents read as the evidence of many projects, with faults that their columns plant.

The SQL restates each rule by itself; the Spark side only binds columns and calls the catalogue.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from panelweave.functions.columns import balanced_group
from panelweave.operators import catalogue as c
from panelweave.operators import task_rules
from panelweave.registry import PAGES, registered
from panelweave.sources.tables import evidence_pages, table

_OUT = "printf('%04d.jpg', pos)"
_OUTPUT = "format_string('%04d.jpg', pos)"
_KEPT = ("project_id", "rule_id", "entity")


def _sql(tables: str, *parts: tuple[str, str, dict[str, str]]) -> str:
    """parts: a table, the entity, and what holds where the rule is kept."""
    return f"with {PAGES}, {tables} " + " union all ".join(f"select project_id, '{rule}' rule_id, cast({entity} as varchar) entity from {source} where not coalesce({ok}, false)" for source, entity, rules in parts for rule, ok in rules.items())


def _projects(pages):
    return pages.groupBy("project_id").agg(F.max("n").cast("int").alias("expected_count"))


def _documents(pages, *columns):
    return pages.selectExpr("project_id", "cast(pos as int) position", *columns)


@registered("v01_output_faults", _sql(f"""o as (select project_id, case when doc_id % 13 = 0 then 'x' || doc_id || '.png' else {_OUT} end e, doc_id % 17 <> 0 f, n_chars >= 120 ok from pg where doc_id % 41 <> 0),
    k as (select p.project_id, n, count(*) filter (f and e like '%.jpg') pages, count(o.e) entries from (select distinct project_id, n from pg) p left join o on o.project_id = p.project_id group by 1, 2), r as (select * from o where f and e like '%.jpg')""",
    ("k", "project_id", {"V01": "pages = n", "V02": "pages = n", "V03": "pages = n and entries = n"}), ("r", "e", {"V04": "ok"})))
def v01_output_faults(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir)
    outputs = pages.filter("doc_id % 41 <> 0").selectExpr("project_id", f"case when doc_id % 13 = 0 then concat('x', doc_id, '.png') else {_OUTPUT} end name", "'s' sha256", "doc_id % 17 <> 0 is_file", "coalesce(n_chars >= 120, false) decodable")
    return c.output_rules(_projects(pages), outputs).select(*_KEPT)


@registered("v05_page_counts", _sql("""k as (select project_id, n, count(*) filter (doc_id % 29 <> 0) a, count(lang) b, count(*) r from pg group by 1, 2)""",
    ("k", "'manifest'", {"V05": "a = n"}), ("k", "'novel alignment'", {"V05": "b = n"}), ("k", "'repair log'", {"V05": "r = n"})))
def v05_page_counts(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir)
    return c.count_rules(_projects(pages), pages.filter("doc_id % 29 <> 0"), pages.filter("lang is not null"), pages).select(*_KEPT)


@registered("v06_header_faults", _sql("""k as (select project_id, n, max(doc_id) m, min(doc_id) l from pg group by 1, 2), h as (select *, if(m % 3 = 0, 'open', 'batch_qa_passed') s, n - if(m % 5 = 0, 1, 0) sc, if(l % 7 = 0, 'other', 'novel') nn, if(l % 2 = 0, 'confirmed', 'provisional') al, if(m % 4 = 0, null, 'batch_qa_passed') rs from k)""",
    ("h", "'manifest'", {"V06": "s = 'batch_qa_passed'", "V07": "sc = n", "V08": "nn = 'novel'"}), ("h", "'alignment'", {"V09": "al = 'confirmed'"}), ("h", "'repair'", {"V09": "rs = 'batch_qa_passed'"})))
def v06_header_faults(spark, sf_dir):
    held = evidence_pages(spark, sf_dir).groupBy("project_id").agg(F.max("n").cast("int").alias("expected_count"), F.max("doc_id").alias("m"), F.min("doc_id").alias("l"))
    projects = held.selectExpr("project_id", "expected_count", "'novel' novel_name", "sha2('novel', 256) novel_sha256")
    said = "expected_count - if(m % 5 = 0, 1, 0) expected_count", "if(l % 7 = 0, 'other', 'novel') novel_name", "sha2('novel', 256) novel_sha256"
    of = lambda name, status: held.selectExpr("project_id", f"'{name}' document", f"{status} status", *said)
    headers = of("manifest", "if(m % 3 = 0, 'open', 'batch_qa_passed')").unionAll(of("alignment", "if(l % 2 = 0, 'confirmed', 'provisional')")).unionAll(of("repair", "if(m % 4 = 0, null, 'batch_qa_passed')"))
    return c.header_rules(projects, headers).select(*_KEPT)


@registered("v10_manifest_faults", _sql(f"""m as (select *, {_OUT} e, if(doc_id % 19 = 0, pos + 1, pos) i, if(lang is null, 'x', {_OUT}) o, if(n_chars < 150, 'other', doc_id || '.jpg') inp, case when doc_id % 6 = 0 then 'page_qa_passed' else 'batch_qa_passed' end s, case when doc_id % 8 = 0 then null when doc_id % 9 = 0 then 'x' else sha256(doc_id || '') end h from pg)""",
    ("m", "e", {"V10": "i = pos and o = e", "V11": "inp = doc_id || '.jpg'", "V12": "s = 'batch_qa_passed'", "V13": "s <> 'batch_qa_passed' or (h is not null and h = sha256(doc_id || '') and doc_id % 37 <> 0)"})))
def v10_manifest_faults(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir)
    inputs = pages.selectExpr("project_id", "cast(pos as int) index", "concat(doc_id, '.jpg') input_name", "'s' input_sha256")
    outputs = pages.filter("doc_id % 37 <> 0").selectExpr("project_id", f"{_OUTPUT} name", "sha2(cast(doc_id as string), 256) sha256", "true is_file")
    manifest = _documents(pages, "cast(if(doc_id % 19 = 0, pos + 1, pos) as int) index", f"if(lang is null, 'x', {_OUTPUT}) output_name", "if(n_chars < 150, 'other', concat(doc_id, '.jpg')) input_name", "'s' input_sha256", "if(doc_id % 6 = 0, 'page_qa_passed', 'batch_qa_passed') state", "case when doc_id % 8 = 0 then null when doc_id % 9 = 0 then 'x' else sha2(cast(doc_id as string), 256) end output_sha256")
    return c.manifest_rules(inputs, manifest, outputs).select(*_KEPT)


@registered("v14_lock_references", _sql(f"""m as (select *, {_OUT} e, 'l' || doc_id % 4 a, 'l' || (doc_id + if(doc_id % 15 = 0, 1, 0)) % 4 b, doc_id % 21 = 0 bare, doc_id % 23 = 0 twice from pg),
    k as (select project_id, 'l' || doc_id % 4 l, list({_OUT}) p from pg where doc_id % 4 <> 3 and doc_id % 5 <> 0 group by 1, 2), w as (select m.*, k.l is not null ka, coalesce(list_contains(k.p, e), false) pa from m left join k on k.project_id = m.project_id and k.l = a), x as (select w.*, k.l is not null kb, coalesce(list_contains(k.p, e), false) pb from w left join k on k.project_id = w.project_id and k.l = b), ua as (select * from x where not bare), ub as (select * from x where not twice)""",
    ("x", "e", {"V14": "not bare", "V25": "doc_id % 31 <> 0", "V26": "not twice", "V27": "not bare and a = b"}), ("ua", "a", {"V15": "ka", "V16": "not ka or pa"}), ("ub", "b", {"V26": "kb and pb"})))
def v14_lock_references(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir)
    manifest = _documents(pages, "if(doc_id % 21 = 0, cast(array() as array<string>), array(concat('l', doc_id % 4))) continuity_lock_ids")
    other = "concat('l', (doc_id + if(doc_id % 15 = 0, 1, 0)) % 4)"
    repair = _documents(pages, "cast(if(doc_id % 31 = 0, 0, pos) as int) index", f"{_OUTPUT} output_name", f"if(doc_id % 23 = 0, array({other}, {other}), array({other})) continuity_lock_ids")
    locks = pages.filter("doc_id % 4 <> 3 and doc_id % 5 <> 0").groupBy("project_id", F.expr("concat('l', doc_id % 4)").alias("lock_id")).agg(F.collect_list(F.expr(_OUTPUT)).alias("applies_to_pages"), F.min("pos").cast("int").alias("position"))
    return c.lock_reference_rules(manifest, repair, locks).select(*_KEPT)


@registered("v17_page_alignment", _sql(f"""m as (select *, {_OUT} e, coalesce(text, '') t, doc_id % 7 <> 0 sure, cast(pos as bigint) st, pos + if(doc_id % 12 = 0, 0, 20) en from pg), s as (select * from m where sure)""",
    ("m", "e", {"V17": "doc_id % 16 <> 0", "V18": "sure"}), ("s", "e", {"V19": "doc_id % 18 <> 0", "V20": "trim(lang) <> ''", "V21": "n_chars > 200 and doc_id % 27 <> 0", "V22": "st < en and en <= 2000", "V23": "doc_id % 12 = 0 or st >= en or en > 2000 or doc_id % 25 <> 0", "V24": "(doc_id % 11) / 10.0 <= 1 and doc_id % 33 <> 0"})))
def v17_page_alignment(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir)
    projects = _projects(pages).selectExpr("project_id", "sha2(project_id, 256) novel_sha256", "repeat('page by page ', 154) novel_text").withColumn("novel_text", F.substring("novel_text", 1, 2000))
    end = "pos + if(doc_id % 12 = 0, 0, 20)"
    alignment = _documents(
        pages, "cast(pos as int) index", f"if(doc_id % 16 = 0, 'x', {_OUTPUT}) output_name", "if(doc_id % 7 = 0 and doc_id % 2 = 0, 'provisional', 'confirmed') status", "if(doc_id % 7 = 0, ' ', 'seen') evidence", "if(doc_id % 18 = 0, 'x', sha2(project_id, 256)) novel_sha256",
        "'1' chapter", "'x' context_excerpt", "'y' located_by", "'z' located_at", "'s' scene_summary", "lang location", "'day' story_time", "if(coalesce(n_chars, 0) > 200, array('a'), cast(array() as array<string>)) involved_characters", "if(doc_id % 27 = 0, array(' '), array('b')) dialogue_owners", "array('c') props",
        "cast(pos as int) start_offset", f"cast({end} as int) end_offset", f"if(doc_id % 25 = 0, 'x', substring(substring(repeat('page by page ', 154), 1, 2000), cast(pos + 1 as int), cast({end} - pos as int))) source_excerpt", "if(doc_id % 33 = 0, 1.5D, (doc_id % 11) / 10D) confidence",
    )
    return c.alignment_rules(projects, alignment).select(*_KEPT)


_ACTIONS, _SCOPES, _MODES, _SIGHTS, _WHYS = ("unchanged_copy", "edited", "redrawn"), ("unchanged", "visual", "text_only", "all"), ("none", "page", "block", "line"), ("not_applicable", "reliable", "unreliable", "guessed"), ("unchanged_page", "visual_repair_requires_page_reset", "no_ordinary_text", "reliable_block_match", "unreliable_text_page_reset", " ")


@registered("v28_policy_values", _sql(f"""m as (select *, {_OUT} e, {list(_ACTIONS)}[k % 3 + 1] a, {list(_SCOPES)}[k // 3 % 4 + 1] s, {list(_SIGHTS)}[k // 12 % 4 + 1] g, {list(_MODES)}[k // 48 % 4 + 1] m, {list(_WHYS)}[k // 192 % 6 + 1] w, n_chars > 500 h from (select *, doc_id * 7 % 1152 k from pg))""",
    ("m", "e", {"V28": "a <> 'redrawn'", "V29": "m <> 'line'", "V30": "s <> 'all'", "V31": "g <> 'guessed'", "V32": "w <> ' '", "V33": "h is not null and ((a = 'unchanged_copy' and s = 'unchanged' and g = 'not_applicable' and m = 'none' and w = 'unchanged_page') or (a = 'edited' and s = 'visual' and h and g in ('reliable', 'unreliable') and m = 'page' and w = 'visual_repair_requires_page_reset') or (a = 'edited' and s = 'visual' and not h and g = 'not_applicable' and m = 'none' and w = 'no_ordinary_text') or (a = 'edited' and s = 'text_only' and h and ((g = 'reliable' and m = 'block' and w = 'reliable_block_match') or (g = 'unreliable' and m = 'page' and w = 'unreliable_text_page_reset'))))"})))
def v28_policy_values(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir).withColumn("k", F.expr("doc_id * 7 % 1152"))
    pick = lambda values, each, name: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("k") / each) % len(values) + 1).cast("int")).alias(name)
    repair = pages.select("project_id", F.col("pos").cast("int").alias("position"), pick(_ACTIONS, 1, "action"), pick(_SCOPES, 3, "repair_scope"), pick(_SIGHTS, 12, "text_recognition"), pick(_MODES, 48, "text_reset_mode"), pick(_WHYS, 192, "text_reset_reason"), (F.col("n_chars") > 500).alias("had_ordinary_text"))
    return c.policy_rules(repair).select(*_KEPT)


@registered("v34_snapshot_files", _sql("""m as (select *, case doc_id % 10 when 0 then '' when 1 then '../' || doc_id when 2 then 'a/../../' || doc_id when 3 then '/' || doc_id when 4 then 'a/../work/none' else 'work/' || doc_id end p from pg),
    u as (select *, doc_id % 10 > 3 safe, doc_id % 10 > 4 and doc_id % 3 <> 0 there, lang is not null same from m), t as (select *, n_chars > 100 tsafe from m)""",
    ("u", "p", {"V34": "safe", "V35": "not safe or there", "V36": "not safe or not there or same"}), ("t", "if(n_chars > 100, 'work/text', '')", {"V34": "tsafe", "V35": "true", "V36": "not coalesce(tsafe, false) or doc_id % 14 <> 0"})))
def v34_snapshot_files(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir)
    path = "case doc_id % 10 when 0 then '' when 1 then concat('../', doc_id) when 2 then concat('a/../../', doc_id) when 3 then concat('/', doc_id) when 4 then 'a/../work/none' else concat('work/', doc_id) end"
    repair = _documents(pages, f"{path} candidate_path", "if(lang is null, 'x', sha2(cast(doc_id as string), 256)) candidate_sha256", "if(n_chars > 100, 'work/text', '') text_snapshot_path", "if(doc_id % 14 = 0, 'x', 'h') text_snapshot_sha256")
    files = pages.filter("doc_id % 10 > 4 and doc_id % 3 <> 0").selectExpr("project_id", "concat('work/', doc_id) path", "sha2(cast(doc_id as string), 256) sha256").unionAll(pages.select("project_id").distinct().selectExpr("project_id", "'work/text'", "'h'"))
    return c.snapshot_rules(repair, files).select(*_KEPT)


@registered("v37_external_candidates", _sql(f"""m as (select *, {_OUT} e, doc_id % 4 k from pg)""",
    ("m", "e", {"V37": "case k when 0 then doc_id % 8 <> 0 when 1 then false else doc_id % 5 <> 0 and doc_id % 6 <> 0 and lang is not null and n_chars >= 150 and doc_id % 9 <> 0 end"})))
def v37_external_candidates(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir)
    run = "if(doc_id % 5 = 0, 'D:/runs/other', 'D:/runs/mend_20260713_080000')"
    source = f"concat({run}, if(doc_id % 6 = 0, '/draft/', '/final/'), doc_id, '.jpg')"
    held = f"map('run_dir', {run}, 'source_path', {source}, 'source_sha256', sha2(cast(doc_id as string), 256), 'imported_at', if(doc_id % 9 = 0, '2026-07-13', '2026-07-13T08:00:00Z'), 'imported_by', coalesce(lang, ' '), 'status', 'supervised_import')"
    repair = _documents(pages, "case doc_id % 4 when 0 then false when 1 then null else true end used_external", f"if(doc_id % 4 = 0 and doc_id % 8 <> 0, null, {held}) external_candidate", "if(coalesce(n_chars, 0) < 150, 'x', sha2(cast(doc_id as string), 256)) candidate_sha256")
    files = pages.selectExpr("project_id", f"{source} path", "sha2(cast(doc_id as string), 256) sha256")
    return c.external_rules(repair, files).select(*_KEPT)


def _map(names, fault: str) -> str:
    """A map of checks that are true, but for the last, which the fault makes false."""
    *most, last = names
    return f"map({', '.join(f"'{x}', true" for x in most)}, '{last}', not coalesce({fault}, false))"


@registered("v38_page_reviews", _sql(f"""m as (select *, {_OUT} e, 'q' || if(doc_id % 20 = 0, doc_id + 20, doc_id) q from pg), ids as (select project_id, q from m where doc_id % 26 <> 0 union all select distinct project_id, 'q' || min(doc_id) over (partition by project_id) from pg), u as (select project_id, q, count(*) c from ids group by 1, 2), w as (select m.*, u.c from m left join u on u.project_id = m.project_id and u.q = m.q)""",
    ("w", "e", {"V38": "n_chars >= 150", "V39": "lang is not null", "V40": "doc_id % 3 <> 0", "V41": "doc_id % 4 <> 0", "V42": "doc_id % 26 <> 0 and doc_id % 5 <> 0", "V43": "doc_id % 26 = 0 or c = 1", "V44": "doc_id % 6 <> 0", "V45": "doc_id % 8 <> 0", "V46": "doc_id % 9 <> 0"})))
def v38_page_reviews(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir)
    seen = f"struct('passed' status, coalesce(n_chars >= 150, false) full_size, lang reviewer, if(doc_id % 3 = 0, '2026-07-13T08:00:00', '2026-07-13T08:00:00+08:00') reviewed_at, {_map(c.VISUAL_CHECKS, 'doc_id % 4 = 0')} checks) visual_review"
    qa = f"struct(if(doc_id % 5 = 0, 'failed', 'passed') status, if(doc_id % 26 = 0, ' ', concat('q', if(doc_id % 20 = 0, doc_id + 20, doc_id))) pass_id, if(doc_id % 6 = 0, '', 'r') reviewer, if(doc_id % 8 = 0, null, '2026-07-13T08:00:00Z') reviewed_at, {_map(c.PAGE_CHECKS, 'doc_id % 9 = 0')} checks) page_qa"
    batches = pages.groupBy("project_id").agg(F.min("doc_id").alias("m")).selectExpr("project_id", "1 position", "struct(concat('q', m) pass_id) batch_qa")
    return c.page_review_rules(_documents(pages, seen, qa), batches).select(*_KEPT)


@registered("v47_batch_contract", _sql(f"""z as (select *, cast(ceil(n / 12.0) as bigint) k from pg), d as (select *, case when pos - 1 < (n - k * (n // k)) * (n // k + 1) then (pos - 1) // (n // k + 1) else (n - k * (n // k)) + (pos - 1 - (n - k * (n // k)) * (n // k + 1)) // (n // k) end b from z),
    g as (select project_id, n, k, b, count(*) size, min(pos) a, max(pos) z, max(doc_id) m, bool_and(doc_id % 10 <> 0) timed, max(doc_id % 9) late from d group by 1, 2, 3, 4), num as (select project_id, n, k, count(*) filter (m % 31 <> 0) found from g group by 1, 2, 3), h as (select *, coalesce(sum(size) over (partition by project_id order by b rows between unbounded preceding and 1 preceding), 0) cur, row_number() over (partition by project_id order by b) r, m % 7 = 0 named from g where m % 31 <> 0),
    i as (select *, if(named, 'twice', 'b' || b) id, sum(if(named, 1, 0)) over (partition by project_id) twice from h), p as (select d.project_id, d.pos, d.doc_id, d.b, i.id from d left join i on i.project_id = d.project_id and i.b = d.b), f as (select *, {_OUT} e from p)""",
    ("num", "project_id", {"V47": "found = k"}), ("i", "id", {"V48": "not named or twice = 1", "V49": "size <= 12 and size = n // k + if(b + 1 <= n % k, 1, 0)", "V50": "cur = a - 1", "V51": "cur = a - 1 and m % 3 <> 0", "V53": "m % 5 <> 0", "V54": "not timed or late < 8"}),
    ("f", "e", {"V52": "id is not null", "V55": "id is not distinct from 'b' || b"})))
def v47_batch_contract(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir).withColumn("b", balanced_group(F.col("pos") - 1, F.col("n"), c.BATCH))
    repair = _documents(pages, "concat('b', b) batch_id", "struct(if(doc_id % 10 = 0, null, concat('2026-07-13T08:0', doc_id % 9, ':00Z')) reviewed_at) page_qa")
    made = pages.groupBy("project_id", "b").agg(F.max("n").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("z"), F.max("doc_id").alias("m")).filter("m % 31 <> 0")
    part = lambda a, b: c.page_names(F.greatest(F.expr(a), F.lit(1)).cast("int"), F.least(F.expr(b), F.col("n")).cast("int"))
    before = F.when(F.col("m") % 3 == 0, F.array(F.lit("x"))).otherwise(part("a - 2", "a - 1"))
    qa = F.expr(f"struct('passed' status, concat('p', b) pass_id, 'r' reviewer, '2026-07-13T08:08:00Z' reviewed_at, {_map(c.BATCH_CHECKS, 'm % 5 = 0')} checks)")
    batches = made.select("project_id", (F.col("b") + 1).cast("int").alias("position"), F.expr("if(m % 7 = 0, 'twice', concat('b', b))").alias("batch_id"), part("a", "z").alias("member_pages"), before.alias("context_before"), part("z + 1", "z + 2").alias("context_after"), qa.alias("batch_qa"))
    return c.batch_rules(_projects(pages), batches, repair).select(*_KEPT)


@registered("v56_final_reports", _sql("""k as (select project_id, n, max(doc_id) m, cast(ceil(n / 12.0) as bigint) b, count(*) filter (doc_id % 41 <> 0) o from pg group by 1, 2)""",
    ("k", "project_id", {"V56": "m % 3 <> 0 and m % 7 <> 0", "V57": "m % 5 <> 0"}), ("k", "'input_count'", {"V58": "m % 4 <> 0"}), ("k", "'output_count'", {"V58": "o = n"}), ("k", "'page_qa_passed'", {"V58": "m % 7 <> 0"}), ("k", "'batch_count'", {"V58": "true"}), ("k", "'batch_qa_passed'", {"V58": "m % 6 <> 0"}), ("k", "'blocking_issues'", {"V58": "true"}), ("k", "'unresolved_issues'", {"V58": "m % 8 <> 0"})))
def v56_final_reports(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir)
    held = pages.groupBy("project_id").agg(F.max("n").alias("n"), F.max("doc_id").alias("m"))
    lines = "array(if(m % 3 = 0, '# REPORT', '# FINAL QA REPORT'), '', if(m % 5 = 0, 'status: open', 'status: passed'), 'reviewer: r', 'reviewed_at: 2026-07-13T08:00:00Z', concat('input_count: ', n + if(m % 4 = 0, 1, 0)), concat('output_count:', n), if(m % 7 = 0, '', concat('page_qa_passed: ', n)), concat('batch_count: ', cast(ceil(n / 12) as bigint), '  '), concat('batch_qa_passed: ', cast(ceil(n / 12) as bigint) - if(m % 6 = 0, 1, 0)), 'blocking_issues: 0', if(m % 8 = 0, 'unresolved_issues: none', 'unresolved_issues: 0'))"
    report = held.select("project_id", F.posexplode(F.expr(lines)).alias("line_no", "line"))
    outputs = pages.filter("doc_id % 41 <> 0").selectExpr("project_id", f"{_OUTPUT} name", "true is_file")
    return c.report_rules(_projects(pages), pages, outputs, report).select(*_KEPT)


@registered("v59_continuity_bible", _sql(f"""k as (select project_id, n, max(doc_id) m from pg group by 1, 2), l as (select *, {list(c.CATEGORIES)}[doc_id % 5 + 1] cat, doc_id // 10 % 4 lid from pg where doc_id % 3 = 0), f as (select *, row_number() over (partition by project_id, lid order by pos) = 1 uno from l),
    e as (select project_id, m, cat, i from k, (select unnest({list(c.CATEGORIES)}) cat, unnest(range(5)) i)), s as (select *, case when (m + i) % 4 = 0 then 'unknown' when (m + i) % 4 = 3 then 'not_applicable' else 'confirmed' end st, 'l' || (m + i) % 4 x from e), o as (select project_id, lid, cat c1 from f where uno), t as (select s.*, o.c1, exists (select 1 from l where l.project_id = s.project_id and l.cat = s.cat) anyl from s left join o on o.project_id = s.project_id and 'l' || o.lid = s.x)""",
    ("k", "project_id", {"V59": "m % 2 = 0", "V60": "m % 3 <> 0", "V61": "m % 5 <> 0", "V62": "m % 7 <> 0", "V63": "project_id in (select project_id from l)"}), ("f", "'l' || lid", {"V64": "doc_id % 4 <> 0", "V65": "uno", "V66": "lang is not null and n_chars >= 150", "V67": "doc_id % 6 <> 0", "V68": "doc_id % 11 <> 0", "V69": "n_chars / 5000.0 <= 1"}),
    ("t", "cat", {"V70": "st <> 'unknown'", "V71": "st <> 'confirmed' or (c1 is not distinct from cat and anyl)", "V72": "st <> 'not_applicable' or m % 2 = 1"})))
def v59_continuity_bible(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir)
    held = pages.groupBy("project_id").agg(F.max("n").cast("int").alias("expected_count"), F.max("doc_id").alias("m"))
    order = f"array({', '.join(f"'{x}'" for x in c.SOURCE_TYPES)})"
    bible = held.selectExpr("project_id", "if(m % 2 = 0, 'confirmed', 'open') status", "if(m % 3 = 0, '', 'r') reviewer", "if(m % 5 = 0, 'x', '2026-07-13T08:00:00Z') reviewed_at", f"if(m % 7 = 0, array('novel'), {order}) source_priority")
    each = held.select("project_id", "m", F.posexplode(F.array(*map(F.lit, c.CATEGORIES))).alias("i", "category"))
    coverage = each.selectExpr("project_id", "category", "case when (m + i) % 4 = 0 then 'unknown' when (m + i) % 4 = 3 then 'not_applicable' else 'confirmed' end status", "if(m % 2 = 1, 'none', ' ') rationale", "if((m + i) % 4 = 3, cast(array() as array<string>), array(concat('l', (m + i) % 4))) lock_ids")
    fields = f"array({', '.join(f"'{x}'" for x in c.LOCK_FIELDS)})"
    category = F.element_at(F.array(*map(F.lit, c.CATEGORIES)), (F.col("doc_id") % 5 + 1).cast("int"))
    locks = pages.filter("doc_id % 3 = 0").withColumn("category", category).selectExpr(
        "project_id", "cast(pos as int) position", f"if(doc_id % 4 = 0, array('lock_id'), {fields}) fields", "concat('l', floor(doc_id / 10) % 4) lock_id", "category", "'s' subject", "lang attribute", "'v' value", "if(coalesce(n_chars, 0) < 150, 'dream', 'novel') source_type", "'r' source_ref",
        f"if(doc_id % 11 = 0, array('9999.jpg'), array({_OUTPUT})) applies_to_pages", "n_chars / 5000D confidence", "'x' created_by", "'2026-07-13T08:00:00Z' created_at", "true confirmed", "if(doc_id % 6 = 0, null, 'y') reviewer", "'2026-07-13T08:00:00Z' reviewed_at",
    )
    return c.bible_rules(held.select("project_id", "expected_count"), bible, coverage, locks).select(*_KEPT)


@registered("v73_style_contract", _sql(f"""m as (select *, {_OUT} e from pg), q as (select * from m where doc_id % 3 <> 0), v as (select *, doc_id // 3 k, least(pos + 1 + doc_id // 3 % 4, n) rp from m where doc_id % 3 = 0), w as (select *, k % 2 = 0 part, k % 7 <> 0 ismode, least(n_chars, 5000) / 5000.0 ratio, least(n_chars, 5000) / 5000.0 + if(k % 10 = 0, 0.05, 0) meas from v), s as (select *, 'a' || doc_id || '.png' x from w where k % 5 = 0)""",
    ("q", "e", {"V73": "doc_id % 8 <> 0"}), ("w", "e", {"V74": "ismode", "V75": "k % 9 <> 0", "V76": "true", "V77": "n <= 1 or abs(rp - pos) between 1 and 2", "V78": "k % 5 <> 0 or k % 3 <> 0", "V80": "ratio > 0 and ratio <= 1", "V81": "abs(meas - ratio) <= 0.01", "V82": "lang is not null", "V83": "k % 4 <> 0",
     "V85": "case when not ismode then true when part then k % 9 <> 0 and meas <> 1 and k % 8 <> 0 else false end"}),
    ("s", "x", {"V78": "k % 2 = 1"}), ("w", "'work/mask' || doc_id", {"V79": "k % 6 <> 0"}), ("w", "'work/compare'", {"V84": "k % 11 <> 0"})))
def v73_style_contract(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir).withColumn("k", F.floor(F.col("doc_id") / 3)).withColumn("visual", F.col("doc_id") % 3 == 0)
    ratio = "least(n_chars, 5000) / 5000D"
    near = "format_string('%04d.jpg', least(pos + 1 + k % 4, n))"
    none = "cast(array() as array<string>)"
    review = f"""if(visual, struct('passed' status, true full_size, lang reviewer, '2026-07-13T08:00:00Z' reviewed_at, 'work/compare' comparison_path, if(k % 11 = 0, 'x', 'h') comparison_sha256, k % 8 = 0 full_page_exception_approved, {_map(c.STYLE_CHECKS, 'k % 4 = 0')} checks),
        struct('not_applicable' status, doc_id % 8 = 0 full_size, cast(null as string) reviewer, cast(null as string) reviewed_at, cast(null as string) comparison_path, cast(null as string) comparison_sha256, false full_page_exception_approved, map({', '.join(f"'{x}', false" for x in c.STYLE_CHECKS)}) checks)) style_review"""
    repair = _documents(
        pages, "if(visual, 'visual', if(doc_id % 2 = 0, 'unchanged', 'text_only')) repair_scope", "case when not visual then 'not_applicable' when k % 7 = 0 then 'other' when k % 2 = 0 then 'localized_inpaint' else 'full_page_regeneration' end visual_edit_mode", "case when not visual then 'not_applicable' when k % 9 = 0 then 'other' else 'localized' end visual_issue_extent",
        f"if(visual, array({near}), {none}) style_reference_pages", f"if(visual and k % 5 = 0, array(concat('a', doc_id, '.png')), {none}) identity_reference_files", "if(visual and k % 5 = 0 and k % 3 <> 0, 'identity_only', 'not_applicable') character_reference_role",
        "if(visual, concat('work/mask', doc_id), null) visual_mask_path", "if(visual, if(k % 6 = 0, 'x', 'h'), null) visual_mask_sha256", f"if(visual, {ratio}, 0D) changed_region_ratio", "cast(null as string) full_page_regeneration_reason", review,
    )
    masks = pages.filter("visual").selectExpr("project_id", "concat('work/mask', doc_id) path", f"{ratio} + if(k % 10 = 0, 0.05D, 0D) coverage", "true same_size")
    files = masks.selectExpr("project_id", "path", "'h' sha256").unionAll(pages.filter("visual").selectExpr("project_id", "'work/compare'", "'h'").distinct())
    # every other sheet that a page names is there
    sheets = pages.filter("visual and k % 5 = 0 and k % 2 = 1").selectExpr("project_id", "concat('人物参考图/a', doc_id, '.png') path", "'s' sha256")
    return c.style_rules(_projects(pages), repair, files.unionAll(sheets), masks).select(*_KEPT)


@registered("v86_schema_faults", _sql("""k as (select project_id, n, max(doc_id) m from pg group by 1, 2), h as (select *, case m % 5 when 0 then '2.0' when 1 then '9' else '3.0' end a, case when m % 5 = 0 then '2.0' when m % 5 = 1 then '9' when m % 7 = 0 then '2.0' else '3.0' end b, m % 5 = 0 legacy, m % 5 > 1 and m % 7 <> 0 new, m % 3 <> 0 moded, m % 4 <> 0 declared from k), x as (select h.* from h where new and moded), y as (select x.*, (select bool_and(lang is not null) from pg where pg.project_id = x.project_id) ok from x)""",
    ("h", "project_id", {"V86": "legacy or new", "V87": "not new or moded", "V88": "case when legacy then false when new and moded then declared else true end"}), ("y", "project_id", {"V89": "ok"})))
def v86_schema_faults(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir)
    held = pages.groupBy("project_id").agg(F.max("doc_id").alias("m"))
    whole = f"array({', '.join(f"'{x}'" for x in c.EVIDENCE_FILES)})"
    of = lambda name, schema: held.selectExpr("project_id", f"'{name}' document", f"{schema} schema_version", "if(m % 3 = 0, cast(null as string), 'scene_cluster_v1') pipeline_mode", f"if(m % 4 = 0, array('x'), {whole}) evidence_files")
    headers = of("manifest", "case m % 5 when 0 then '2.0' when 1 then '9' else '3.0' end").unionAll(of("repair", "case when m % 5 = 0 then '2.0' when m % 5 = 1 then '9' when m % 7 = 0 then '2.0' else '3.0' end"))
    rows = _documents(pages, "'c' cluster_id", "'p' reference_pack_id", "'t' task_id", "array('r') failure_rule_ids", "'g' generated_by", "'v' reviewed_by", f"{_OUTPUT} output_name", "if(lang is null, 'x', concat(doc_id, '.jpg')) input_name")
    inputs = pages.selectExpr("project_id", "cast(pos as int) index", "concat(doc_id, '.jpg') input_name")
    return c.schema_rules(headers, rows, rows, inputs, _projects(pages)).select(*_KEPT)


@registered("v90_cluster_contract", _sql("""d as (select *, (pos - 1) // 10 g from pg), k as (select project_id, n, g, count(*) size, min(pos) a, max(pos) z, max(doc_id) m from d group by 1, 2, 3), f as (select *, if(m % 11 = 0, 'same', 'c' || g) id, row_number() over (partition by project_id, if(m % 11 = 0, 'same', 'c' || g) order by g) = 1 uno, m % 13 = 0 dup from k), u as (select * from f where uno),
    r as (select *, coalesce(sum(size) over (partition by project_id order by g rows between unbounded preceding and 1 preceding), 0) cur from u where not dup), p as (select project_id, n, coalesce((select sum(size) = p.n and bool_and(cur = a - 1) from r where r.project_id = p.project_id), false) ok from (select distinct project_id, n from pg) p)""",
    ("f", "id", {"V90": "uno"}), ("u", "id", {"V91": "not dup"}), ("r", "id", {"V92": "size <= 20 and (m % 3 = 0) = (size < 8)", "V93": "m % 3 <> 0 or (m % 2 = 0 and n < 8 and size = n)", "V94": "cur = a - 1", "V95": "cur = a - 1", "V96": "m % 5 <> 0", "V97": "m % 7 <> 0"}), ("p", "project_id", {"V98": "ok"})))
def v90_cluster_contract(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir).withColumn("g", F.floor((F.col("pos") - 1) / 10))
    made = pages.groupBy("project_id", "g").agg(F.max("n").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("z"), F.max("doc_id").alias("m"))
    part = lambda a, b: c.page_names(F.greatest(F.expr(a), F.lit(1)).cast("int"), F.least(F.expr(b), F.col("n")).cast("int"))
    members = F.when(F.col("m") % 13 == 0, F.array_repeat(F.format_string("%04d.jpg", "a"), 2)).otherwise(part("a", "z"))
    clusters = made.select(
        "project_id", (F.col("g") + 1).cast("int").alias("position"), F.expr("if(m % 11 = 0, 'same', concat('c', g))").alias("cluster_id"), members.alias("member_pages"), (F.col("m") % 3 == 0).alias("undersized"), (F.col("m") % 2 == 0).alias("boundary_exception"), F.lit("project_total_below_min").alias("undersized_reason"),
        part("a - 2", "a - 1").alias("context_before"), part("z + 1", "z + 2").alias("context_after"), F.when(F.col("m") % 5 == 0, "x").otherwise(F.format_string("%04d.jpg", "z")).alias("canary_page"), F.when(F.col("m") % 7 == 0, "open").otherwise("bound").alias("reference_pack_state"), F.lit("p").alias("reference_pack_id"),
    )
    return c.cluster_rules(_projects(pages), clusters).select(*_KEPT)


#: name and type of each column of a task record
_TASK_COLUMNS = [tuple(part.strip().split(" ", 1)) for part in re.split(r",\s*(?![^<]*>)", task_rules.TASKS)]


@registered("v99_task_contract", _sql("""t as (select project_id, pos, doc_id, if(doc_id % 22 = 0, 'same', 't' || doc_id) id, ['completed', 'completed', 'queued', 'lost'][doc_id % 4 + 1] s, printf('%04d', if(doc_id % 19 = 0, pos + 1, pos)) p from pg where doc_id % 17 <> 0), u as (select *, count(*) over (partition by project_id, id) c from t),
    o as (select project_id, p, count(*) c, any_value(id) id, any_value(s) s from t group by 1, 2), w as (select project_id, pos, printf('%04d', pos) p, 't' || doc_id a, if(doc_id % 23 = 0, 'x', 't' || doc_id) b from pg), j as (select coalesce(w.project_id, o.project_id) project_id, coalesce(w.p, o.p) p, a, b, c, id, s from w full join o on o.project_id = w.project_id and o.p = w.p)""",
    ("u", "id", {"V99": "c = 1", "V100": "s = 'completed'", "V101": "s <> 'lost'"}), ("j", "p", {"V102": "a = b and c = 1 and id = a and s = 'completed'"})))
def v99_task_contract(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir)
    tasks = pages.filter("doc_id % 17 <> 0").selectExpr("project_id", "if(doc_id % 22 = 0, 'same', concat('t', doc_id)) task_id", "element_at(array('completed', 'completed', 'queued', 'lost'), cast(doc_id % 4 + 1 as int)) state", "format_string('%04d', if(doc_id % 19 = 0, pos + 1, pos)) page_id")
    # of the queue's findings, those that the tasks' states give
    records = tasks.select(*(F.col(k) if k in tasks.columns else F.lit(None).cast(v).alias(k) for k, v in _TASK_COLUMNS))
    found = task_rules.record_faults(records).filter("fault = 'state_unknown'")
    return c.task_rules(_projects(pages), _documents(pages, "concat('t', doc_id) task_id"), _documents(pages, "if(doc_id % 23 = 0, 'x', concat('t', doc_id)) task_id"), tasks, found).select(*_KEPT)


@registered("v103_rule_uses", _sql(f"""m as (select *, {_OUT} e, 'r' || doc_id % 9 a, 'r' || (doc_id + if(doc_id % 14 = 0, 1, 0)) % 9 b from pg), f as (select *, a = b and doc_id % 16 <> 0 fine from m), u as (select * from f where fine), s as (select distinct project_id, 's' || doc_id % 3 x from pg where lang is null)""",
    ("s", "x", {"V103": "false"}), ("f", "e", {"V104": "fine"}), ("u", "b", {"V104": "doc_id % 9 < 7"})))
def v103_rule_uses(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir)
    manifest = _documents(pages, "array(concat('r', doc_id % 9)) failure_rule_ids")
    other = "concat('r', (doc_id + if(doc_id % 14 = 0, 1, 0)) % 9)"
    repair = _documents(pages, f"if(doc_id % 16 = 0, array({other}, {other}), array({other})) failure_rule_ids")
    rules = pages.select("project_id").distinct().select("project_id", F.explode(F.expr("transform(sequence(0, 6), i -> concat('r', i))")).alias("rule_id"))
    faults = pages.filter("lang is null").selectExpr("project_id", "concat('s', doc_id % 3) entity").distinct()
    return c.rule_use_rules(manifest, repair, rules, faults).select(*_KEPT)


_REFS = """'[{"path":"' || case when doc_id % 6 = 0 then 'pages/rejected' else 'pages/' || doc_id end || '","role":"primary_style","sha256":"' || sha256(doc_id || '') || '"}]'"""


@registered("v105_pack_contract", _sql(f"""m as (select *, 'c' || pos cid, {_REFS} refs, if(doc_id % 6 = 0, 'pages/rejected', 'pages/' || doc_id) p from pg), i as (select *, sha256('{{"cluster_id":"' || cid || '","references":' || refs || '}}') made from m), b as (select *, if(doc_id % 8 = 0, 'pack-x', made) id, sha256('{{"reference_pack_id":"' || made || '","references":' || refs || '}}') bind from i), u as (select *, count(*) over (partition by project_id, id) c from b),
    st as (select project_id, p, count(*) c from m where doc_id % 5 <> 0 group by 1, 2), ap as (select project_id, p, if(doc_id % 12 = 0, ' ', sha256(doc_id || '')) h from m where doc_id % 6 <> 0), w as (select u.*, st.p is not null stable from u left join st on st.project_id = u.project_id and st.p = u.p)""",
    ("st", "p", {"V105": "c = 1"}), ("ap", "p", {"V106": "h <> ' '"}), ("w", "id", {"V107": "c = 1", "V108": "stable and doc_id % 6 <> 0", "V109": "id = made", "V110": "lang is not null"}), ("w", "id || ' ' || p", {"V111": "doc_id % 6 <> 0 and doc_id % 7 <> 0 and doc_id % 12 <> 0"}), ("w", "cid", {"V112": "id <> 'pack-x' or (c = 1 and doc_id % 8 = 0)"})))
def v105_pack_contract(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir).withColumn("path", F.expr("if(doc_id % 6 = 0, 'pages/rejected', concat('pages/', doc_id))"))
    refs = F.array(F.struct("path", F.lit("primary_style").alias("role"), F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256")))
    packs = c.pack_ids(pages.select("project_id", "doc_id", "lang", F.concat(F.lit("c"), "pos").alias("cluster_id"), refs.alias("references")))
    packs = packs.selectExpr("project_id", "if(doc_id % 8 = 0, 'pack-x', content_id) reference_pack_id", "cluster_id", "`references`", "if(lang is null, 'x', content_binding) reference_binding_hash", "doc_id")
    stable, approved = pages.filter("doc_id % 5 <> 0").select("project_id", "path"), pages.filter("doc_id % 6 <> 0").selectExpr("project_id", "path", "if(doc_id % 12 = 0, ' ', sha2(cast(doc_id as string), 256)) sha256")
    files = pages.filter("doc_id % 7 <> 0 and doc_id % 6 <> 0").selectExpr("project_id", "path", "sha2(cast(doc_id as string), 256) sha256")
    once = packs.groupBy("project_id", "reference_pack_id").agg(F.count("*").alias("n"))
    clusters = packs.join(once, ["project_id", "reference_pack_id"]).selectExpr("project_id", "cluster_id", "if(reference_pack_id = 'pack-x' and n > 1, 'none', reference_pack_id) reference_pack_id")
    return c.pack_rules(packs.drop("doc_id"), stable, approved, files, clusters).select(*_KEPT)


@registered("v113_page_traces", _sql(f"""m as (select *, {_OUT} e, doc_id % 10 k from pg)""",
    ("m", "e", {"V113": "k <> 0", "V114": "k <> 0 and k <> 1", "V115": "lang is not null and k <> 2", "V116": "n_chars < 500 or lang is null or k <> 3", "V117": "k <> 3 and k <> 4", "V118": "lang is not null and k <> 5 and k <> 6 and k <> 0", "V119": "doc_id % 7 <> 0 or (lang is not null and k <> 3 and k <> 8)"})))
def v113_page_traces(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir).withColumn("k", F.col("doc_id") % 10).withColumn("reviewer", F.expr("if(k = 3, coalesce(lang, 'nobody'), 'reader')"))
    packs = c.pack_ids(pages.select("project_id", F.lit("c").alias("cluster_id")).distinct().withColumn("references", F.array(F.struct(F.lit("a").alias("path"), F.lit("primary_style").alias("role"), F.lit("s").alias("sha256")))))
    packs = packs.selectExpr("project_id", "'p' reference_pack_id", "cluster_id", "`references`", "content_binding")
    manifest = _documents(pages, "'o' output_sha256", "'c' cluster_id", "if(k = 1, 'q', 'p') reference_pack_id", "concat('t', doc_id) task_id", "if(k = 2, 'other', lang) generated_by", "reviewer reviewed_by")
    repair = _documents(pages, "if(k = 0, 'z', 'c') cluster_id", "if(k = 1, 'q', 'p') reference_pack_id", "concat('t', doc_id) task_id", "lang generated_by", "reviewer reviewed_by", "if(n_chars < 500, 'unchanged', 'visual') repair_scope", "if(doc_id % 7 = 0, 'full_page_regeneration', 'localized_inpaint') visual_edit_mode", "struct(if(k = 4 or k = 3, 'x', 'reader') reviewer) page_qa", "struct(if(k = 8, lang, 'styler') reviewer) style_review", "struct('looker' reviewer) visual_review")
    clusters = pages.groupBy("project_id").agg(F.lit("c").alias("cluster_id"), F.lit("p").alias("reference_pack_id"), F.collect_list(F.expr(_OUTPUT)).alias("member_pages"))
    tasks = pages.join(packs.select("project_id", "content_binding"), "project_id").selectExpr("project_id", "concat('t', doc_id) task_id", "format_string('%04d', if(k = 5, pos + 1, pos)) page_id", "'completed' state", "'c' cluster_id", "if(k = 6, 'x', 'o') candidate_hash", "coalesce(lang, 'somebody') completed_by", "content_binding prompt_reference_hash")
    return c.trace_rules(manifest, repair, clusters, packs.drop("content_binding"), tasks).select(*_KEPT)


@registered("v120_cluster_reviews", _sql("""d as (select *, (pos - 1) // 10 g from pg), k as (select project_id, g, max(doc_id) m, min(lang) l from d group by 1, 2), q as (select *, if(m % 4 = 0, l, 'reader') r, if(m % 6 = 0, 'same', project_id || g) p from k where m % 9 <> 0), u as (select *, count(*) over (partition by project_id, p) c from q)""",
    ("k", "'c' || g", {"V120": "m % 9 <> 0"}), ("u", "'c' || g", {"V121": "m % 5 <> 0", "V122": "m % 7 <> 0 and c = 1", "V123": "r is not null and m % 8 <> 0", "V124": "m % 4 <> 0 or r is null"})))
def v120_cluster_reviews(spark, sf_dir):
    pages = evidence_pages(spark, sf_dir).withColumn("g", F.floor((F.col("pos") - 1) / 10))
    made = pages.groupBy("project_id", "g").agg(F.max("doc_id").alias("m"), F.min("lang").alias("l"), F.array_sort(F.collect_list(F.expr(_OUTPUT))).alias("member_pages"))
    clusters = made.selectExpr("project_id", "cast(g as int) position", "concat('c', g) cluster_id", "member_pages", "member_pages[0] canary_page")
    qa = made.filter("m % 9 <> 0").selectExpr("project_id", "cast(g as int) position", "concat('c', g) cluster_id", "member_pages", "if(m % 5 = 0, 'x', member_pages[0]) canary_page", "if(m % 7 = 0, 'open', 'passed') status", "if(m % 6 = 0, 'same', concat(project_id, g)) pass_id", "if(m % 4 = 0, l, 'reader') reviewed_by", "if(m % 8 = 0, '2026-07-13', '2026-07-13T08:00:00Z') reviewed_at")
    return c.cluster_qa_rules(clusters, qa, _documents(pages, "lang generated_by")).select(*_KEPT)


@registered("v125_registry_hashes", """with r as (select event_id, json_extract_string(props, '$.k') k from events where props is not null) select 'user-' || user_id project_id, 'V125' rule_id, cast(event_id as varchar) entity from events join r using (event_id) where event_id % 3 = 0 or event_id % 5 = 0""")
def v125_registry_hashes(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("props is not null")
    right = F.sha2(F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit("}")), 256)
    said = F.when(F.col("event_id") % 3 == 0, "x").otherwise(right)
    body = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit(',"registry_hash":"'), said, F.lit('"'))), F.lit("}"))
    return c.registry_rules(events.select(F.concat(F.lit("user-"), F.col("user_id")).alias("project_id"), F.col("event_id").cast("string").alias("document"), body.alias("body"))).select(*_KEPT)
