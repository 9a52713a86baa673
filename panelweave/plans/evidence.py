"""Queries that hold evidence documents against each other, and the rule catalogue over rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.functions.columns import balanced_group
from panelweave.functions.text import json_hash
from panelweave.operators import evidence, migration, rules
from panelweave.operators.sequence import placed
from panelweave.registry import STORY, balanced_sql, registered
from panelweave.sources.tables import story_pages, table


@registered("j2_row_lookups", """select c_nationkey % 5 project_id, c_custkey, case when c.cnt is not null then 'supplier_key' when n.c is not null then 'nation_key' end "by", case when c.cnt = 1 then c.v when c.cnt is null and n.c = 1 then n.v end "value", case when c.cnt is not null then c.cnt > 1 when n.c is not null then n.c > 1 end ambiguous
    from customer left join (select s_nationkey % 5 p, s_suppkey k, min(s_nationkey) v, count(*) cnt from supplier group by 1, 2) c on c.k = c_custkey and c.p = c_nationkey % 5 left join (select s_nationkey % 5 p, s_nationkey k, min(s_nationkey) v, count(*) c from supplier group by 1, 2) n on n.k = c_nationkey and n.p = c_nationkey % 5""")
def j2_row_lookups(spark, sf_dir):
    pages = table(spark, sf_dir, "customer").selectExpr("c_nationkey % 5 project_id", "c_custkey", "c_nationkey")
    rows = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("project_id"), F.col("s_suppkey").alias("supplier_key"), F.col("s_nationkey").alias("nation_key"), F.col("s_nationkey").alias("value"))
    return evidence.first_by_priority(pages, rows, [("c_custkey", "supplier_key"), ("c_nationkey", "nation_key")], "value").drop("c_nationkey")


@registered("j3_trace_differences", """with a as (select o_orderkey k, o_orderstatus status, cast(o_custkey % 7 as bigint) part from orders), b as (select l_orderkey k, max(l_linestatus) status, max(l_linenumber)::bigint part from lineitem group by 1)
    select coalesce(a.k, b.k) page, unnest(case when a.k is null or b.k is null then ['row'] else list_filter([case when a.status is distinct from b.status then 'status' end, case when a.part is distinct from b.part then 'part' end], lambda x: x is not null) end) field from a full join b on a.k = b.k""")
def j3_trace_differences(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 7).alias("part"))
    right = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.max("l_linestatus").alias("status"), F.max("l_linenumber").cast("bigint").alias("part"))
    return evidence.trace_differences(left, right, "page", "status", "part")


@registered("j6_not_exactly_one", "with u as (select distinct c_custkey k from customer), h as (select o_custkey k, count(*) filter (o_orderstatus = 'P') n from orders group by 1 having count(*) filter (o_orderstatus = 'P') > 0) select coalesce(u.k, h.k) page, u.k is not null known, coalesce(n, 0) hits from u full join h on u.k = h.k where u.k is null or n is null or n <> 1")
def j6_not_exactly_one(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("page"))
    return evidence.not_exactly_one(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page")), done, "page")


@registered("j7_lock_faults", """with u as (select distinct l_orderkey % 3 project_id, l_orderkey page, l_partkey lock_id from lineitem), k as (select distinct p_size % 4 project_id, p_partkey lock_id from part), a as (select distinct l_linenumber % 3 project_id, l_partkey lock_id, l_orderkey page from lineitem)
    select u.project_id, u.page, u.lock_id, case when k.lock_id is null then 'lock_unknown' else 'lock_not_applicable' end fault from u left join k on k.lock_id = u.lock_id and k.project_id = u.project_id left join a on a.lock_id = u.lock_id and a.page = u.page and a.project_id = u.project_id where k.lock_id is null or a.lock_id is null""")
def j7_lock_faults(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 3 project_id", "l_linenumber % 3 other", "l_orderkey page", "l_partkey lock_id")
    locks = table(spark, sf_dir, "part").selectExpr("p_size % 4 project_id", "p_partkey lock_id")
    return evidence.lock_faults(lines, locks, lines.drop("project_id").withColumnRenamed("other", "project_id"))


@registered("j8_hash_chains", """select coalesce(source, 'none') project_id, doc_id path, case when l.doc_id is null then 'file_missing' when sha is distinct from b.approved then 'approval_differs' else 'file_differs' end fault from (select source, doc_id, sha256(coalesce(text, '')) sha from documents) d
    left join (select doc_id, case when n_chars % 5 = 0 then sha256('x') else sha256(coalesce(text, '')) end approved from documents) b using (doc_id) left join (select labels.doc_id, case when toxic = 1 then sha256('y') else sha256(coalesce(text, '')) end of_file from labels join documents using (doc_id)) l using (doc_id)
    where l.doc_id is null or sha is distinct from b.approved or sha <> l.of_file""")
def j8_hash_chains(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("project_id"), F.col("doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "n_chars")
    approved = docs.select("project_id", "path", F.when(F.col("n_chars") % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha")).alias("sha"))
    files = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), "toxic"), "path").select("project_id", "path", F.when(F.col("toxic") == 1, F.sha2(F.lit("y"), 256)).otherwise(F.col("sha")).alias("sha"))
    return evidence.hash_chain_faults(docs, approved, files)


@registered("u4_lock_set_differences", """with a as (select l_orderkey page, list(distinct l_linenumber) m from lineitem where l_returnflag <> 'R' group by 1), b as (select l_orderkey page, list(distinct l_linenumber) m from lineitem where l_linestatus = 'O' group by 1), j as (select coalesce(a.page, b.page) page, coalesce(a.m, []) x, coalesce(b.m, []) y from a full join b on a.page = b.page)
    select page, len(list_filter(x, lambda i: not list_contains(y, i))) only_left, len(list_filter(y, lambda i: not list_contains(x, i))) only_right from j where list_sort(x) <> list_sort(y)""")
def u4_lock_set_differences(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page")
    return evidence.set_differences(lines.filter("l_returnflag <> 'R'"), lines.filter("l_linestatus = 'O'"), "page", "l_linenumber")


@registered("a2_count_gates", """with f as (select source project_id, count(*) found from documents group by 1), e as (select source project_id, count(distinct text) expected from documents where source is not null group by 1) select coalesce(f.project_id, e.project_id) project_id, coalesce(found, 0) found, expected, case when coalesce(found, 0) not between 1 and 9999 then 'count_out_of_range' else 'count_differs' end fault
    from f full join e on f.project_id = e.project_id where coalesce(found, 0) not between 1 and 9999 or found is distinct from expected""")
def a2_count_gates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "project_id")
    return evidence.count_gates(docs, docs.filter("project_id is not null").groupBy("project_id").agg(F.countDistinct("text").alias("n")))


@registered("v47_batch_faults", f"""with {STORY}, m as (select *, case when risk % 11 = 0 then pos // 12 else {balanced_sql('pos', 'total', 12)} end batch, {balanced_sql('pos', 'total', 12)} want from story), s as (select *, count(*) over (partition by project_id, batch) size from m)
    select project_id, pos, 'size_over_limit' fault from s where size > 12 union all select project_id, pos, 'not_deterministic' from s where batch is distinct from want""")
def v47_batch_faults(spark, sf_dir):
    pages = placed(story_pages(spark, sf_dir))
    told = pages.withColumn("batch", F.when(F.col("risk") % 11 == 0, F.floor(F.col("pos") / 12)).otherwise(balanced_group(F.col("pos"), F.col("total"), 12)))
    return evidence.batch_faults(told).select("project_id", F.col("pos").cast("bigint").alias("pos"), "fault")


@registered("a22_early_reviews", "select o_orderkey batch from orders join (select l_orderkey, max(l_shipdate) latest from lineitem group by 1) on l_orderkey = o_orderkey where o_orderdate <= latest")
def a22_early_reviews(spark, sf_dir):
    read = lambda name, key, at: table(spark, sf_dir, name).select(F.col(key).alias("batch"), F.col(at).alias("at"))
    return evidence.early_reviews(read("orders", "o_orderkey", "o_orderdate"), read("lineitem", "l_orderkey", "l_shipdate"))


_SEGMENTS = ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE")


@registered("a23_coverage_faults", f"""with cov as (select c_nationkey project_id, c_mktsegment category, case when avg(c_acctbal) > 4500 then 'confirmed' else 'not_applicable' end status, case when min(c_custkey) % 2 = 0 then 'r' else ' ' end rationale from customer group by 1, 2),
    locks as (select c_nationkey project_id, c_mktsegment category, count(*) n from customer where c_acctbal > 9000 group by 1, 2), e as (select project_id, category from (select distinct project_id from cov), (select unnest({list(_SEGMENTS)}) category)),
    t as (select project_id, category, status, rationale, coalesce(n, 0) n from e left join cov using (project_id, category) left join locks using (project_id, category)), f as (select project_id, category, case when status is null then 'not_stated' when status = 'confirmed' and n = 0 then 'confirmed_without_lock' when status = 'not_applicable' and n > 0 then 'not_applicable_with_lock' when status = 'not_applicable' and trim(rationale) = '' then 'rationale_missing' end fault from t)
    select * from f where fault is not null""")
def a23_coverage_faults(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_mktsegment").alias("category"), "c_acctbal", "c_custkey")
    stated = customers.groupBy("project_id", "category").agg(F.when(F.avg("c_acctbal") > 4500, "confirmed").otherwise("not_applicable").alias("status"), F.when(F.min("c_custkey") % 2 == 0, "r").otherwise(" ").alias("rationale"))
    return evidence.coverage_faults(stated, customers.filter("c_acctbal > 9000"), _SEGMENTS)


@registered("a20_snapshot_digests", """with recursive r as (select distinct source, '{"doc_id":' || doc_id || ',"sha":"' || sha256(coalesce(text, '')) || '"}' j, doc_id, sha256(coalesce(text, '')) sha from documents), p as (select source, j, row_number() over (partition by source order by doc_id, sha) - 1 pos, count(*) over (partition by source) total from r),
    t as (select source, pos // 1000 pos, (total + 999) // 1000 total, sha256('[' || string_agg(j, ',' order by pos) || ']') d from p group by source, pos // 1000, total union all select source, pos // 1000, (total + 999) // 1000, sha256('[' || string_agg('"' || d || '"', ',' order by pos) || ']') from t where total > 1 group by source, pos // 1000, total) select source, d set_hash from t where total = 1""")
def a20_snapshot_digests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return evidence.digest_of_set(docs, "source", "doc_id", "sha")


_STATES = {"confirmed": 0, "provisional": 1, "unresolved": 2}


@registered("a11_alignment_states", f"""with {STORY}, s as (select *, {balanced_sql('pos', 'total', 12)} batch, case when location is null then 2 when risk < 300 then 1 else 0 end r from story) select project_id, batch, ['confirmed', 'provisional', 'unresolved'][max(r) + 1] state, count(*) filter (r > 0) unconfirmed from s group by 1, 2""")
def a11_alignment_states(spark, sf_dir):
    state = F.when(F.col("location").isNull(), "unresolved").when(F.col("risk") < 300, "provisional").otherwise("confirmed")
    pages = placed(story_pages(spark, sf_dir)).withColumn("batch", balanced_group(F.col("pos"), F.col("total"), 12)).withColumn("state", state)
    return pages.groupBy("project_id", "batch").agg(evidence.worst(_STATES, "state").alias("state"), F.count_if(F.col("state") != "confirmed").alias("unconfirmed"))


@registered("p32_registry_hashes", """select event_id, sha256('{"k":' || json_extract_string(props, '$.k') || '}') registry_hash from events where props is not null""")
def p32_registry_hashes(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("props is not null").select("event_id", json_hash(F.col("props"), "registry_hash").alias("registry_hash"))


@registered("u2_field_differences", """select event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x not in ('v'))), ',') unknown, array_to_string(list_filter(['v'], lambda x: not list_contains(json_keys(props), x)), ',') missing from events where props is not null""")
def u2_field_differences(spark, sf_dir):
    keys, wanted = F.json_object_keys("props"), F.array(F.lit("v"))
    return table(spark, sf_dir, "events").filter("props is not null").select("event_id", F.array_join(F.array_sort(F.array_except(keys, wanted)), ",").alias("unknown"), F.array_join(F.array_except(wanted, keys), ",").alias("missing"))


@registered("p25_page_ranges", r"""with f as (select page_id, regexp_extract(url, '([^/]*)$', 1) name from pages) select page_id, name from f where regexp_matches(name, '^[0-9]+(\([0-9]+\))?$') and cast(regexp_extract(name, '^([0-9]+)', 1) as decimal(38, 0)) not between 1 and 9999""")
def p25_page_ranges(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("name")).filter(F.col("name").rlike(r"^[0-9]+(\([0-9]+\))?$") & ~migration.page_in_range(F.col("name")))


# the catalogue over rows: a rule is the condition of its fault, in Spark and in SQL

_TOLD = "told as (select conv_id page, turn block, coalesce(role, '') speaker, coalesce(text, '') t from conversations), spans as (select *, coalesce(sum(length(t) + 1) over (partition by page order by block, speaker, t rows between unbounded preceding and 1 preceding), 0)::bigint \"start\" from told), al as (select *, \"start\" + length(t) - case when block % 5 = 4 then length(t) else 0 end \"end\", case when block % 3 = 0 then 'provisional' else 'confirmed' end status, (page % 12) / 10.0 confidence from spans)"
_ALIGNMENT = {"alignment_mapping": ("block < 0", "block < 0"), "alignment_not_confirmed": ("status <> 'confirmed' or trim(t) = ''", "status <> 'confirmed' or trim(t) = ''"), "offset_range": ('"start" < 0 or "start" >= "end"', "start < 0 or start >= end"), "characters_missing": ("speaker = ''", "speaker = ''"), "confidence_range": ("confidence not between 0 and 1", "confidence not between 0 and 1"), "excerpt_length": ('"end" - "start" <> length(t)', "end - start <> length(t)")}


def _sql_faults(source: str, faults: dict, *keys: str) -> str:
    return " union all ".join(f"select {', '.join(keys)}, '{name}' rule_id from {source} where {sql}" for name, (sql, _) in faults.items())


def _faults(faults: dict) -> dict:
    return {name: F.expr(spark) for name, (_, spark) in faults.items()}


@registered("v17_alignment_faults", f"with {_TOLD} {_sql_faults('al', _ALIGNMENT, 'page', 'block', 'speaker')}")
def v17_alignment_faults(spark, sf_dir):
    told = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("block"), F.coalesce("role", F.lit("")).alias("speaker"), F.coalesce("text", F.lit("")).alias("t"))
    ahead = Window.partitionBy("page").orderBy("block", "speaker", "t").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("t") + 1).over(ahead), F.lit(0))
    al = told.withColumn("start", start).withColumn("end", F.col("start") + F.length("t") - F.when(F.col("block") % 5 == 4, F.length("t")).otherwise(0))
    al = al.withColumn("status", F.when(F.col("block") % 3 == 0, "provisional").otherwise("confirmed")).withColumn("confidence", (F.col("page") % 12) / 10)
    return rules.violations(al, _faults(_ALIGNMENT), "page", "block", "speaker")


_REPAIR = {
    "action_value": ("action not in ('unchanged_copy', 'edited')",) * 2, "scope_value": ("scope not in ('unchanged', 'text_only', 'visual')",) * 2, "recognition_value": ("recognition not in ('not_applicable', 'reliable', 'unreliable')",) * 2,
    "review_not_passed": ("review <> 'passed' or reviewer is null",) * 2, "review_time": ("reviewed is null",) * 2, "reviewer_is_generator": ("reviewer = generator",) * 2, "pass_id_missing": ("coalesce(pass_id, '') = ''",) * 2, "checks_failed": ("checks < 3",) * 2,
}


@registered("v28_repair_faults", f"""with r as (select l_orderkey page, l_linenumber line, l_partkey part, case l_returnflag when 'A' then 'edited' when 'N' then 'unchanged_copy' else 'redrawn' end action, case l_linestatus when 'O' then 'visual' else 'text' end scope, ['not_applicable', 'reliable', 'guessed'][cast(l_linenumber % 3 as int) + 1] recognition, case when l_discount < 0.09 then 'passed' else 'failed' end review, l_suppkey % 10 reviewer, l_partkey % 10 generator, l_shipdate reviewed, case when l_tax > 0.07 then '' else 'p' end pass_id, l_linenumber checks from lineitem) {_sql_faults('r', _REPAIR, 'page', 'line', 'part')}""")
def v28_repair_faults(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey page", "l_linenumber line", "l_partkey part", "case l_returnflag when 'A' then 'edited' when 'N' then 'unchanged_copy' else 'redrawn' end action", "case l_linestatus when 'O' then 'visual' else 'text' end scope", "array('not_applicable', 'reliable', 'guessed')[l_linenumber % 3] recognition",
        "case when l_discount < 0.09 then 'passed' else 'failed' end review", "l_suppkey % 10 reviewer", "l_partkey % 10 generator", "l_shipdate reviewed", "case when l_tax > 0.07 then '' else 'p' end pass_id", "l_linenumber checks",
    )
    return rules.violations(rows, _faults(_REPAIR), "page", "line", "part")


_LOCKS = {"lock_category": ("category not in ('BUILDING', 'MACHINERY', 'FURNITURE')",) * 2, "lock_value": ("coalesce(trim(value), '') = ''",) * 2, "lock_confidence": ("confidence not between 0 and 1",) * 2, "lock_not_confirmed": ("not confirmed",) * 2, "lock_created": ("created is null",) * 2}


@registered("v64_lock_faults", f"with k as (select o_orderkey lock_id, c_mktsegment category, c_name \"value\", c_acctbal / 5000 confidence, o_orderstatus <> 'P' confirmed, o_orderdate created from orders join customer on c_custkey = o_custkey) {_sql_faults('k', _LOCKS, 'lock_id')}")
def v64_lock_faults(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    locks = joined.selectExpr("o_orderkey lock_id", "c_mktsegment category", "c_name value", "c_acctbal / 5000 confidence", "o_orderstatus <> 'P' confirmed", "o_orderdate created")
    return rules.violations(locks, _faults(_LOCKS), "lock_id")


@registered("v_project_verdicts", """with v as (select source p, 'location_missing' r from documents where lang is null union all select source, 'excerpt_short' from documents where n_chars < 120 union all select source, 'excerpt_long' from documents where n_chars > 4000), c as (select p, count(*) n, count(distinct r) k from v group by 1)
    select project_id, coalesce(n, 0) violations, coalesce(k, 0) rules, coalesce(n, 0) = 0 ok from (select distinct source project_id from documents) d left join c on c.p is not distinct from project_id""")
def v_project_verdicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "project_id")
    faults = {"location_missing": F.col("lang").isNull(), "excerpt_short": F.col("n_chars") < 120, "excerpt_long": F.col("n_chars") > 4000}
    return evidence.verdicts(docs, rules.violations(docs, faults, "project_id"))


@registered("j5_task_mismatches", """select l_orderkey page, unnest(case when o_orderkey is null then ['task_missing'] else list_filter([case when l_linestatus is distinct from o_orderstatus then 'state_differs' end, case when l_suppkey % 50 is distinct from o_custkey % 50 then 'actor_differs' end], lambda x: x is not null) end) fault from lineitem left join (select * from orders where o_orderpriority <> '5-LOW') on o_orderkey = l_orderkey""")
def j5_task_mismatches(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_orderkey").alias("task_id"), F.col("l_linestatus").alias("state"), (F.col("l_suppkey") % 50).alias("actor"))
    tasks = table(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("state"), (F.col("o_custkey") % 50).alias("actor"))
    return evidence.task_mismatches(pages, tasks, "state", "actor")


@registered("j22_batch_gates", """with m as (select s_nationkey % 4 p, s_suppkey pos, 'n' || s_nationkey "name" from supplier), r as (select c_nationkey % 4 p, c_custkey pos, 'n' || c_nationkey "name", c_custkey // 2 id, count(*) over (partition by c_nationkey % 4, c_custkey // 2) n from customer),
    j as (select coalesce(m.p, r.p) project_id, coalesce(m.pos, r.pos) "position", coalesce(m."name", r."name") "name", case when r.pos is null then 'report_missing' when m.pos is null then 'report_extra' when m."name" <> r."name" then 'name_differs' when n > 1 then 'report_id_repeated' end fault from m full join r on m.pos = r.pos and m.p = r.p) select * from j where fault is not null""")
def j22_batch_gates(spark, sf_dir):
    named = lambda key, nation: ((F.col(nation) % 4).alias("project_id"), F.col(key).alias("position"), F.concat(F.lit("n"), F.col(nation)).alias("name"))
    reports = table(spark, sf_dir, "customer").select(*named("c_custkey", "c_nationkey"), F.floor(F.col("c_custkey") / 2).alias("report_id"))
    return evidence.batch_gate(table(spark, sf_dir, "supplier").select(*named("s_suppkey", "s_nationkey")), reports)
