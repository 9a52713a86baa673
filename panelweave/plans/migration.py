"""Queries over the migration plan and redraw requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import migration, requests, rules, sequence
from panelweave.registry import FILES, STORY, balanced_sql, registered
from panelweave.sources.tables import story_pages, table

_SPELLED = ("Copy-Original", " no_change", "Text-Repair", "page_reset", "REDRAW", "regenerate", "unknown", "")
_CLASS = "case when u then 'evidence_blocked' " + " ".join(f"when a in {names} then '{kind[0]}'" for kind, names in rules.CLASSES.items()) + " else 'evidence_blocked' end"
_TYPE = "case when u then 'evidence_resolution' " + " ".join(f"when a in {names} then '{kind[1]}'" for kind, names in rules.CLASSES.items()) + " else 'evidence_resolution' end"
_PLAN = f"""{STORY}, c as (select *, coalesce(risk < 300, true) u, replace(lower(trim({list(_SPELLED)}[page_id % 8 + 1])), '-', '_') a, {balanced_sql('pos', 'total', 12)} "cluster" from story),
    k as (select *, {_CLASS} page_class, {_TYPE} task_type, row_number() over (partition by project_id, "cluster" order by pos) - 1 = (count(*) over (partition by project_id, "cluster") - 1) // 2 is_canary from c),
    h as (select *, sha256('{{"cluster":' || "cluster"::bigint || ',"page_class":"' || page_class || '","page_id":' || page_id || ',"project_id":' || coalesce('"' || project_id || '"', 'null') || '}}') payload_hash from k),
    plan as (select *, sha256('{{"page_id":' || page_id || ',"payload_hash":"' || payload_hash || '","task_type":"' || task_type || '"}}') task_id, row_number() over (partition by project_id order by is_canary desc, "cluster", pos) task_order from h)"""


def _plan(spark, sf_dir):
    action = F.element_at(F.array(*map(F.lit, _SPELLED)), (F.col("page_id") % 8 + 1).cast("int"))
    return migration.planned_tasks(story_pages(spark, sf_dir).withColumn("unresolved", F.coalesce(F.col("risk") < 300, F.lit(True))).withColumn("action", action))


@registered("m4_migration_plan", f"""with {_PLAN} select project_id, page_id, "cluster", page_class, case page_class when 'unchanged' then 'unchanged' when 'text_only' then 'text_only' when 'full_page_redraw' then 'full_page_regeneration' else 'evidence_blocked' end planned_action, is_canary, task_id, task_order from plan""")
def m4_migration_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("project_id", "page_id", "cluster", "page_class", "planned_action", "is_canary", "task_id", "task_order")


@registered("a27_plan_summaries", f"""with {_PLAN} select project_id, count(*) pages, count(distinct "cluster") clusters, count(*) filter (u) unresolved, {', '.join(f"count(*) filter (page_class = '{c}') n_{c}" for c in migration.ACTIONS)}, count(*) filter (page_class = 'evidence_blocked') = 0 ready from plan group by 1""")
def a27_plan_summaries(spark, sf_dir):
    return migration.plan_summary(_plan(spark, sf_dir))


@registered("a27_page_lists", f"""with {STORY}, s as (select *, case when location is null then 'unresolved' when risk < 300 then 'provisional' else 'confirmed' end st from story) select project_id, count(*) pages, coalesce(string_agg(page_id, ',' order by page_id) filter (st = 'unresolved'), '') unresolved_pages, coalesce(string_agg(page_id, ',' order by page_id) filter (st <> 'confirmed'), '') unconfirmed_pages from s group by 1""")
def a27_page_lists(spark, sf_dir):
    state = F.when(F.col("location").isNull(), "unresolved").when(F.col("risk") < 300, "provisional").otherwise("confirmed")
    made = migration.page_lists(story_pages(spark, sf_dir).withColumn("state", state))
    return made.select("project_id", "pages", F.array_join("unresolved_pages", ",").alias("unresolved_pages"), F.array_join("unconfirmed_pages", ",").alias("unconfirmed_pages"))


@registered("w11_membership_faults", f"""with {STORY}, m as (select *, row_number() over (partition by project_id order by case when page_id % 50 = 7 then pos + 3 else pos end, page_id) - 1 at_pos from story where risk >= 300) select s.project_id, count(*) filter (m.page_id is null) uncovered, 0::bigint "unknown", count(*) filter (m.at_pos <> s.pos) out_of_order
    from story s left join m on m.project_id = s.project_id and m.page_id = s.page_id group by 1 having count(*) filter (m.page_id is null) + count(*) filter (m.at_pos <> s.pos) > 0""")
def w11_membership_faults(spark, sf_dir):
    pages = sequence.placed(story_pages(spark, sf_dir)).select("project_id", "page_id", "pos", "risk")
    told = pages.filter("risk >= 300").select("project_id", F.when(F.col("page_id") % 50 == 7, F.col("pos") + 3).otherwise(F.col("pos")).alias("cluster"), F.col("page_id").alias("place"), "page_id")
    return migration.membership_faults(told, pages.drop("risk"))


@registered("p24_bound_candidates", rf"""with {FILES}, c as (select page_id, project_id, project_id || '/' || stem || case page_id % 3 when 0 then '_candidate_2.png' when 1 then '_1_visual.png' else '/new.png' end path, stem, regexp_matches(stem, '^[0-9]+$') num, page_id % 3 k from (select page_id, project_id, regexp_replace(name, '\.[^.]*$', '') stem from files)),
    p as (select distinct project_id, stem page from c union select distinct project_id, stem || '(1)' from c where num and cast(stem as hugeint) % 2 = 0),
    f as (select *, case when k = 0 then case when num then stem else coalesce(nullif(regexp_extract(stem, '^([0-9]+(\([0-9]+\))?)', 1), ''), stem) end when k = 1 and num then stem || '(1)' when k = 1 then coalesce(nullif(regexp_extract(stem, '^([0-9]+(\([0-9]+\))?)', 1), ''), stem || '_1') else coalesce(nullif(regexp_extract(stem, '^([0-9]+(\([0-9]+\))?)', 1), ''), nullif(stem, '')) end near from c)
    select f.project_id, page_id, p.page from f left join p on p.page = f.near and p.project_id = f.project_id""")
def p24_bound_candidates(spark, sf_dir):
    name = F.regexp_replace(F.regexp_extract("url", "([^/]*)$", 1), r"\.[^.]*$", "")
    told = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("project_id"), name.alias("stem"))
    tail = F.when(F.col("page_id") % 3 == 0, "_candidate_2.png").when(F.col("page_id") % 3 == 1, "_1_visual.png").otherwise("/new.png")
    candidates = told.select("project_id", "page_id", F.concat("project_id", F.lit("/"), "stem", tail).alias("path"))
    even = told.filter(F.col("stem").rlike("^[0-9]+$") & F.substring("stem", -1, 1).isin("0", "2", "4", "6", "8"))
    pages = told.select("project_id", F.col("stem").alias("page")).union(even.select("project_id", F.concat("stem", F.lit("(1)"))))
    return migration.bound_candidates(candidates, pages, "page_id")


@registered("r1_redraw_requests", r"""with d as (select distinct l_orderkey page, l_linenumber n, l_partkey p from lineitem where l_returnflag = 'R'), f as (select page, '[' || string_agg('{"l_linenumber":' || n || ',"l_partkey":' || p || '}', ',' order by n, p) || ']' facts from d group by 1),
    l as (select o_orderkey page, '[{"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}]' locks from orders join customer on c_custkey = o_custkey),
    r as (select o_orderkey page, concat_ws(chr(10), 'redraw-request/1', '## facts', coalesce(facts, '[]'), '## locks', coalesce(locks, '[]')) request from orders left join f on f.page = o_orderkey left join l on l.page = o_orderkey)
    select page, length(request) length, sha256('{"text":"' || replace(replace(request, '"', '\"'), chr(10), '\n') || '","version":"redraw-request/1"}') fingerprint from r""")
def r1_redraw_requests(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").withColumnRenamed("o_orderkey", "page")
    facts = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "page")
    parts = {"facts": requests.section(facts, "page", "l_linenumber", "l_partkey"), "locks": requests.section(orders.filter("c_custkey is not null"), "page", "c_mktsegment", "c_name")}
    made = requests.redraw_requests(orders, parts, "page")
    return made.select("page", F.length("request").cast("bigint").alias("length"), "fingerprint")


@registered("r8_block_faults", r"""with b as (select conv_id page, turn block, count(*) n, bool_or(coalesce(length(regexp_replace(text, '\s', '', 'g')) > 25 and role <> 'system', false)) o from conversations group by 1, 2), p as (select page, bool_or(n > 1) r, bool_or(o) o from b group by 1) select page, 'balloon_repeated' fault from p where r union all select page, 'over_budget_without_reason' from p where o""")
def r8_block_faults(spark, sf_dir):
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("block"), "text", F.when(F.col("role") == "system", "long by nature").alias("reason"))
    return requests.block_faults(blocks)


@registered("r6_rule_context_faults", """with u as (select l_orderkey page, l_suppkey % 10 cluster, l_linestatus "character", ['page', 'cluster', 'project'][cast(l_linenumber % 3 as int) + 1] "scope", case when l_partkey % 4 = 0 then l_orderkey end rule_page, case when l_partkey % 4 = 1 then l_suppkey % 10 end rule_cluster, case when l_returnflag <> 'A' then 'O' end rule_character, l_linenumber line, l_partkey part from lineitem),
    f as (select page, line, part, case when ("scope" = 'page' and rule_page is distinct from page) or ("scope" = 'cluster' and rule_cluster is distinct from cluster) or ("scope" = 'project' and (rule_page is not null or rule_cluster is not null)) then 'scope_differs' when rule_character is not null and rule_character is distinct from "character" then 'character_differs' end fault from u) select * from f where fault is not null""")
def r6_rule_context_faults(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey page", "l_suppkey % 10 cluster", "l_linestatus character", "array('page', 'cluster', 'project')[l_linenumber % 3] scope", "if(l_partkey % 4 = 0, l_orderkey, null) rule_page", "if(l_partkey % 4 = 1, l_suppkey % 10, null) rule_cluster", "if(l_returnflag <> 'A', 'O', null) rule_character", "l_linenumber line", "l_partkey part")
    return requests.rule_context_faults(uses).select("page", "line", "part", "fault")


@registered("r11_size_faults", "select p_partkey from part where coalesce(case when p_size % 3 <> 0 then 896 + p_size // 40 end, 896) <> 896")
def r11_size_faults(spark, sf_dir):
    specs = table(spark, sf_dir, "part").select("p_partkey", F.expr("if(p_size % 3 <> 0, 896 + p_size div 40, null)").alias("width"), F.lit(None).cast("int").alias("height"))
    return requests.size_faults(specs, "p_partkey")
