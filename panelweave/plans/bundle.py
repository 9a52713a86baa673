"""Queries of migration bundles: documents, pages and events as skeletons, reports, reviews, blockers and guarded values."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import bundle as b
from panelweave.operators import preflight as pre
from panelweave.registry import FILES, PAGES, balanced_sql, registered
from panelweave.sources.tables import evidence_pages, table, url_pages

_CLASSES = ("unchanged", "text_only", "full_page_redraw", "evidence_blocked")
_ACTS = ("unchanged", "text_only", "full_page_regeneration", "evidence_blocked")


def _inputs(spark, sf_dir):
    return evidence_pages(spark, sf_dir).selectExpr("project_id", "cast(pos as int) index", "concat(doc_id, '.jpg') input_name", "sha2(coalesce(text, ''), 256) input_sha256")


@registered("s13_evidence_skeletons", f"""with {PAGES} select project_id, cast(pos as int) "index", doc_id || '.jpg' input_name, sha256(coalesce(text, '')) input_sha256, printf('%04d.jpg', pos) output_name, printf('batch-%03d', {balanced_sql('(pos - 1)', 'n', 12)} + 1) batch_id, 'inventoried' state, cast(null as varchar) task_id, cast(null as int) start_offset from pg""")
def s13_evidence_skeletons(spark, sf_dir):
    return b.skeletons(_inputs(spark, sf_dir)).select("project_id", "index", "input_name", "input_sha256", "output_name", "batch_id", "state", "task_id", "start_offset")


@registered("s16_proposals", f"""with {PAGES} select project_id, printf('%04d.jpg', pos) output_name, 'c' || (pos - 1) // 20 cluster_id, 't' || doc_id task_id, {list(_CLASSES)}[doc_id % 4 + 1] page_class, {list(_ACTS)}[doc_id % 4 + 1] "action", true proposal_only from pg""")
def s16_proposals(spark, sf_dir):
    classes = f"array({', '.join(f"'{c}'" for c in _CLASSES)})"
    traces = evidence_pages(spark, sf_dir).selectExpr("project_id", "format_string('%04d.jpg', pos) output_name", "concat('c', floor((pos - 1) / 20)) cluster_id", "'p' reference_pack_id", "concat('t', doc_id) task_id", f"element_at({classes}, cast(doc_id % 4 + 1 as int)) page_class")
    return b.proposals(b.skeletons(_inputs(spark, sf_dir)), traces).select("project_id", "output_name", "cluster_id", "task_id", "page_class", "action", "proposal_only")


@registered("u6_id_differences", """with a as (select l_suppkey id from lineitem where l_quantity > 25), c as (select c_custkey id from customer) select id, 'left' side from (select id from a except all select id from c) union all select id, 'right' from (select id from c except all select id from a)""")
def u6_id_differences(spark, sf_dir):
    return b.id_differences(table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_suppkey").alias("id")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id")


@registered("j9_pack_styles", rf"""with {FILES}, k as (select *, page_id % 5 k from files), p as (select project_id, page_id, 'x/' || case k when 0 then 'Rejected/' when 1 then 'a/../' when 2 then 'Character-Sheet ' else '' end || name path, k, page_id % 2 = 0 stable from k)
    select project_id, page_id reference_pack_id, path, unnest(list_filter([case when not stable then 'not_stable' end, case when k in (0, 2) then 'style_contaminated' end], lambda f: f is not null)) fault from p""")
def j9_pack_styles(spark, sf_dir):
    packs = url_pages(spark, sf_dir).selectExpr("project_id", "page_id reference_pack_id", "concat('x/', case page_id % 5 when 0 then 'Rejected/' when 1 then 'a/../' when 2 then 'Character-Sheet ' else '' end, name) path", "'primary_style' role", "name")
    packs = packs.withColumn("own", F.concat("path", F.lit("#"), "reference_pack_id"))
    stable = packs.filter("reference_pack_id % 2 = 0").select("project_id", F.col("own").alias("path"))
    found = b.style_faults(packs.select("project_id", "reference_pack_id", F.col("own").alias("path"), "role"), stable)
    return found.withColumn("path", F.regexp_replace("path", "#[0-9]+$", ""))


@registered("m2_recomputed_preflights", """with e as (select vec_id, vec_id % 4 k, vec_id % 6 j from embeddings) select vec_id, unnest(list_filter([case when k = 0 then 'candidate_unknown' end, case when k = 1 then 'check_differs' end, case when k <> 0 and j = 5 then 'status_differs' end], lambda f: f is not null)) fault from e""")
def m2_recomputed_preflights(spark, sf_dir):
    pairs = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "true candidate_ok", "true original_ok", "vec_id % 3 <> 0 same_size", "cast(vec_id % 50 as double) variance", "0.1D edge_delta", "1D mean_delta", "1D std_delta", "'textless' policy", "vec_id % 5 <> 0 ocr_ok")
    now = pre.preflight(pairs)
    changed = F.transform("checks", lambda x: F.struct(x["name"].alias("name"), F.when((F.col("vec_id") % 4 == 1) & (x["name"] == "text_policy"), "not_applicable").otherwise(x["status"]).alias("status")))
    reports = now.select("vec_id", changed.alias("checks"), F.when(F.col("vec_id") % 6 == 5, "unsure").otherwise(F.col("status")).alias("status"))
    return b.recomputed(reports, now.filter("vec_id % 4 <> 0"), "vec_id")


@registered("m5_class_faults", f"""with d as (select doc_id, {list(_CLASSES)}[doc_id % 4 + 1] c, lang is null other, doc_id % 9 = 0 act, doc_id % 10 = 0 tsk, n_chars < 150 blk, doc_id % 3 = 0 rel from documents)
    select doc_id, unnest(list_filter([case when other and c <> 'unchanged' then 'page_class_differs' end, case when act then 'action_differs' end, case when tsk then 'task_class_differs' end, case when coalesce(blk, true) and coalesce(rel, true) then 'blocked_page_released' end], lambda f: f is not null)) fault from d""")
def m5_class_faults(spark, sf_dir):
    pick = lambda values: f"element_at(array({', '.join(f"'{c}'" for c in values)}), cast(doc_id % 4 + 1 as int))"
    own = "if(lang is null, 'unchanged', " + pick(_CLASSES) + ")"
    acts = "if(lang is null, 'unchanged', " + pick(_ACTS) + ")"
    pages = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{pick(_CLASSES)} manifest_class", f"{own} repair_class", f"if(doc_id % 10 = 0, 'x', {pick(_CLASSES)}) task_class", f"if(doc_id % 9 = 0, 'x', {acts}) action", "n_chars < 150 blocked", "doc_id % 3 = 0 released")
    return b.class_faults(pages, "doc_id")


@registered("m6_migration_reviews", """with o as (select o_orderkey id, o_orderkey % 7 k, o_custkey % 5 a, o_orderkey % 6 r from orders), d as (select distinct id, k, a, r from o), u as (select id, min(k) k, min(a) a, min(r) r from d group by 1)
    select cast(id as varchar) migration_id, unnest(list_filter([case when k = 0 then 'review_id_differs' end, case when k = 1 then 'reviewer_missing' end, case when k <> 1 and a = r then 'not_independent' end, case when k = 2 then 'decision_unknown' end, case when k = 3 then 'time_without_zone' end, case when k = 4 then 'digest_differs' end, case when k = 5 then 'author_differs' end], lambda f: f is not null)) fault from u""")
def m6_migration_reviews(spark, sf_dir):
    base = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("id")).agg(F.min(F.col("o_custkey") % 5).alias("a")).withColumn("k", F.col("id") % 7).withColumn("r", F.col("id") % 6)
    told = base.selectExpr("id", "k", "cast(id as string) migration_id", "sha2(concat('d', id, if(k = 4, 'x', '')), 256) confirmed_report_digest", "concat('P', a) prepared_by", "if(k = 1, ' ', concat('p', r)) reviewed_by", "if(k = 3, '2026-07-13T08:00:00', '2026-07-13T08:00:00Z') reviewed_at", "if(k = 2, 'maybe', ' Accepted') decision", "cast(null as string) notes")
    made = b.reviews(told).withColumn("review_id", F.when(F.col("migration_id").cast("bigint") % 7 == 0, "x").otherwise(F.col("review_id")))
    reports = base.selectExpr("cast(id as string) migration_id", "sha2(concat('d', id), 256) confirmed_report_digest", "concat('P', a, if(k = 5, 'x', '')) prepared_by")
    return b.review_faults(made, reports)


@registered("m7_report_hashes", """select event_id, unnest(list_filter([case when event_id % 5 = 0 then 'integrity_hash_malformed' end, case when event_id % 5 = 0 or event_id % 7 = 0 then 'integrity_hash_differs' end, case when event_id % 6 = 0 then 'digest_malformed' end, case when event_id % 6 = 0 or event_id % 11 = 0 then 'digest_differs' end], lambda f: f is not null)) fault from events where props is not null""")
def m7_report_hashes(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    events = table(spark, sf_dir, "events").filter("props is not null").select("event_id", k.alias("k"))
    plain = F.concat(F.lit('{"k":'), "k", F.lit("}"))
    digest = F.when(F.col("event_id") % 6 == 0, "no").when(F.col("event_id") % 11 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(plain, 256))
    events = events.withColumn("digest", digest)
    body = F.concat(F.lit('{"confirmed_report_digest":"'), "digest", F.lit('","k":'), "k", F.lit(',"migration_id":"m"}'))
    seal = F.when(F.col("event_id") % 5 == 0, "no").when(F.col("event_id") % 7 == 0, F.sha2(F.lit("y"), 256)).otherwise(F.sha2(body, 256))
    whole = F.concat(F.lit('{"report_integrity_hash":"'), seal, F.lit('","migration_id":"m","k":'), "k", F.lit(',"confirmed_report_digest":"'), "digest", F.lit('"}'))
    return b.report_faults(events.select("event_id", whole.alias("body")), "event_id")


@registered("m8_rejected_candidates", rf"""with {FILES}, c as (select page_id, coalesce(project_id, '') project_id, regexp_replace(name, '\.[^.]*$', '') stem from files), n as (select *, case when regexp_matches(stem, '^[0-9]+_[0-9]+(_|$)') then regexp_replace(stem, '^([0-9]+)_([0-9]+).*$', '\1(\2)') else coalesce(nullif(regexp_extract(stem, '^([0-9]+(\([0-9]+\))?)', 1), ''), stem) end near from c), k as (select distinct project_id, stem from c where regexp_matches(stem, '^[0-9]*[02468]$'))
    select n.project_id, page_id, k.stem page, k.stem is not null bound from n left join k on k.stem = n.near and k.project_id = n.project_id""")
def m8_rejected_candidates(spark, sf_dir):
    told = url_pages(spark, sf_dir).select("page_id", F.coalesce("project_id", F.lit("")).alias("project_id"), F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"))
    candidates = told.select("project_id", "page_id", F.concat(F.lit("rejected/of-"), F.col("page_id").cast("string"), F.lit("/"), "stem", F.lit("_candidate.png")).alias("path"), F.lit("s").alias("sha256"))
    pages = told.filter(F.col("stem").rlike("^[0-9]+$") & F.substring("stem", -1, 1).isin("0", "2", "4", "6", "8")).select("project_id", F.col("stem").alias("page"))
    seen, lost = b.rejected_failures(candidates, pages, "page_id")
    lost = candidates.join(lost.select("project_id", F.get_json_object("blocker", "$.path").alias("path")).distinct(), ["project_id", "path"])
    return seen.select("project_id", "page_id", "page", F.lit(True).alias("bound")).unionAll(lost.select("project_id", "page_id", F.lit(None).cast("string"), F.lit(False)))


@registered("m9_snapshot_drift", """with j as (select 'suppliers' kind, a.s_suppkey x, b.c_custkey y, a.s_nationkey u, b.c_nationkey v from supplier a full join customer b on a.s_suppkey = b.c_custkey union all select 'orders', a.o_orderkey, b.l_orderkey, 1, 1 from (select distinct o_orderkey from orders) a full join (select distinct l_orderkey from lineitem) b on a.o_orderkey = b.l_orderkey)
    select kind, count(*) filter (x is null) added, count(*) filter (y is null) removed, count(*) filter (x is not null and y is not null and u is distinct from v) changed from j group by 1""")
def m9_snapshot_drift(spark, sf_dir):
    of = lambda name, key, value: table(spark, sf_dir, name).selectExpr(f"cast({key} as bigint) key", f"cast({value} as int) value").distinct()
    return b.drift({"suppliers": of("supplier", "s_suppkey", "s_nationkey"), "orders": of("orders", "o_orderkey", "1")}, {"suppliers": of("customer", "c_custkey", "c_nationkey"), "orders": of("lineitem", "l_orderkey", "1")}, "key", "value")


@registered("a26_migration_gates", f"""with {PAGES}, s as (select *, printf('%04d', pos) page, case when lang is null then 'unresolved' when n_chars < 150 then 'provisional' else 'confirmed' end st, max(case when lang is null then 2 when n_chars < 150 then 1 else 0 end) over (partition by project_id, (pos - 1) // 10) w from pg), t as (select *, ['confirmed', 'provisional', 'unresolved'][w + 1] cs, doc_id % 4 <> 0 blk from s),
    x as (select project_id, '{{"code":"UNCONFIRMED_ALIGNMENT_PAGES","pages":["' || string_agg(page, '","' order by page) || '"]}}' bl from t where st <> 'confirmed' or cs <> 'confirmed' group by 1 union all select project_id, '{{"code":"CLUSTER_ALIGNMENT_CONTROL_MISMATCH","page":"' || page || '"}}' from t where cs <> st or (st = 'unresolved' and not blk)
        union all select project_id, '{{"code":"EXACT_BIJECTION_INVALID"}}' from pg group by 1 having max(doc_id) % 3 = 0)
    select p.project_id, sha256(coalesce(string_agg(bl, chr(10) order by bl), '')) blockers, count(bl) n, max(doc_id) % 3 <> 0 exact_bijection, max(doc_id) % 3 <> 0 and count(bl) = 0 ready from (select project_id, max(doc_id) doc_id from pg group by 1) p left join x on x.project_id = p.project_id group by 1""")
def a26_migration_gates(spark, sf_dir):
    from pyspark.sql import Window

    pages = evidence_pages(spark, sf_dir).withColumn("page", F.format_string("%04d", "pos")).withColumn("state", F.expr("case when lang is null then 'unresolved' when n_chars < 150 then 'provisional' else 'confirmed' end"))
    rank = F.max(F.expr("case when state = 'unresolved' then 2 when state = 'provisional' then 1 else 0 end")).over(Window.partitionBy("project_id", F.floor((F.col("pos") - 1) / 10)))
    pages = pages.withColumn("w", rank).withColumn("cluster_state", F.expr("element_at(array('confirmed', 'provisional', 'unresolved'), w + 1)")).withColumn("cluster_blocked", F.col("doc_id") % 4 != 0)
    exact = pages.groupBy("project_id").agg((F.max("doc_id") % 3 != 0).alias("exact"))
    made = b.gate(pages, [b.alignment_blockers(pages)], exact)
    return made.select("project_id", F.sha2(F.array_join("blockers", "\n"), 256).alias("blockers"), F.size("blockers").cast("bigint").alias("n"), "exact_bijection", "ready")


@registered("p18_cache_keys", """select doc_id, sha256('{"generation_hash":"' || coalesce(lang, 'x') || '","prompt_hash":"' || sha256(coalesce(text, '')) || '","reference_hash":"' || coalesce(source, 'y') || '"}') cache_key from documents""")
def p18_cache_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "sha2(coalesce(text, ''), 256) p", "coalesce(source, 'y') r", "coalesce(lang, 'x') g")
    return rows.select("doc_id", b.cache_key("p", "r", "g").alias("cache_key"))


@registered("p28_ocr_data", """with d as (select doc_id, n_chars - 200 c, doc_id % 5 k, doc_id % 7 j, coalesce(lang, ' ') l from documents), f as (select doc_id, list_filter([case when not coalesce(c >= 0, false) then 'count_invalid' end, case when k = 0 then 'unexpected_missing' end, case when (k <> 0 and l = ' ') or j = 0 then 'text_blank' end], lambda x: x is not null) f from d)
    select d.doc_id, array_to_string(f, ',') faults, case when j = 0 then 1 else 2 end n_allowed from d join f using (doc_id)""")
def p28_ocr_data(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "n_chars - 200 n", "if(doc_id % 5 = 0, null, array(coalesce(lang, ' '))) u", "if(doc_id % 7 = 0, array(' a', 'a ', ' '), array(' a', 'b', 'a ')) a", "cast(null as array<string>) d")
    wrong = b.ocr_faults(rows, "doc_id", "n", "u", "a", "d").groupBy("doc_id").agg(F.collect_list("fault").alias("f"))
    order = F.array(F.lit("count_invalid"), F.lit("unexpected_missing"), F.lit("text_blank"))
    made = rows.select("doc_id", *(v.alias(k) for k, v in b.ocr_normal("n", "u", "a", "d").items())).join(wrong, "doc_id", "left")
    told = F.array_join(F.filter(order, lambda x: F.array_contains(F.coalesce("f", F.array().cast("array<string>")), x)), ",")
    return made.select("doc_id", told.alias("faults"), F.size(F.array_compact("allowlisted_art_text")).alias("n_allowed"))


@registered("p35_guarded_values", """select doc_id, unnest(list_filter([case when coalesce(trim(source), '') = '' then 'source_no_text' end, case when lang is null then 'tags_no_list' end, case when not coalesce(n_chars - 300 > 0, false) then 'count_not_positive' end, case when doc_id % 9 in (0, 1) or n_chars is null then 'ratio_not_finite' end], lambda f: f is not null)) fault from documents""")
def p35_guarded_values(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "array(lang) tags", "n_chars - 300 count", "case doc_id % 9 when 0 then double('NaN') when 1 then double('-Infinity') else n_chars / 10D end ratio")
    return b.guard_faults(rows, "doc_id", ("source",), ("tags",), ("count",), ("ratio",))


@registered("st9_untimed_fields", """select event_id, unnest(list_filter([case when event_id % 3 = 0 then 'created_at_without_zone' end, case when event_id % 5 = 0 then 'timestamp_without_zone' end], lambda f: f is not null)) fault from events""")
def st9_untimed_fields(spark, sf_dir):
    spelled = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"concat({spelled}, if(event_id % 3 = 0, '', 'Z')) created_at", f"if(event_id % 5 = 0, 'soon', concat({spelled}, '+08:00')) timestamp", "cast(null as string) reviewed_at", "'no time' attended")
    return b.untimed(rows, "event_id")
