"""Queries of compiled requests: documents as redraw specs, conversations as text specs, and specs with planted faults."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.operators import compiled as m
from panelweave.registry import registered
from panelweave.sources.tables import table

_W = m.WORDING
_QUOTE = lambda x: f"coalesce(cast(to_json({x}) as varchar), 'null')"
_REQUEST = f"""d as (select doc_id, cast(doc_id as varchar) pg, source cl, [coalesce(lang, 'x'), 'b'] ch, substr(coalesce(text, ''), 1, 60) su, [substr(coalesce(text, ''), 61, 40), 'n"' || doc_id] fa from documents),
    q as (select *, 'PROMPT_VERSION={m.VERSION}' || chr(10) || chr(10) || array_to_string([
    '## TASK' || chr(10) || '- redraw_page_id=' || {_QUOTE('pg')} || chr(10) || '- cluster_id=' || {_QUOTE('cl')} || chr(10) || '- characters=' || {_QUOTE('ch')} || chr(10) || '{_W['TASK']}',
    '## SOURCE FACTS' || chr(10) || '- scene_summary=' || {_QUOTE('su')} || chr(10) || '- novel_fact=' || {_QUOTE('fa[1]')} || chr(10) || '- novel_fact=' || {_QUOTE('fa[2]')} || chr(10) || '{_W['SOURCE FACTS']}',
    '## COMPOSITION LOCK' || chr(10) || '- ROLE=target_original PATH="in/' || doc_id || '.jpg"' || chr(10) || case when doc_id % 3 = 0 then '- lock="keep ' || doc_id || '"' else '- none' end,
    '## IDENTITY LOCKS' || chr(10) || '{_W['IDENTITY LOCKS']}' || chr(10) || '- none', '## CONTINUITY LOCKS' || chr(10) || case when doc_id % 3 <> 0 then '- lock="keep ' || doc_id || '"' else '- none' end,
    '## STYLE CONTRACT' || chr(10) || '- ROLE=adjacent_style PATH="in/' || (doc_id + 1) || '.jpg"' || chr(10) || '{_W['STYLE CONTRACT']}' || chr(10) || '- none',
    '## TEXT POLICY' || chr(10) || case when doc_id % 4 = 0 then '- keep art text=["' || doc_id || '"]' else '- textless' end, '## EFFECTIVE FAILURE RULES' || chr(10) || case when doc_id % 5 = 0 then '- rule={{"rule_id":"r' || doc_id || '","scope":"page","character":null}}' else '- none' end,
    '## NEGATIVE CONSTRAINTS' || chr(10) || '{_W['NEGATIVE CONSTRAINTS']}', '## OUTPUT CONTRACT' || chr(10) || '{_W['OUTPUT CONTRACT']}'], chr(10) || chr(10)) || chr(10) request from d)"""


def _specs(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "cast(doc_id as string) page_id", "source cluster_id", "array(coalesce(lang, 'x'), 'b') characters", "substring(coalesce(text, ''), 1, 60) scene_summary", "array(substring(coalesce(text, ''), 61, 40), concat('n\"', doc_id)) novel_facts",
        "array(struct(concat('in/', doc_id, '.jpg') path, 'target_original' role), struct(concat('in/', doc_id + 1, '.jpg') path, 'adjacent_style' role)) `references`", "array(struct(if(doc_id % 3 = 0, 'composition', 'continuity') category, concat('keep ', doc_id) text)) locks",
        "if(doc_id % 5 = 0, array(struct(concat('r', doc_id) rule_id, 'page' scope, cast(null as string) character)), cast(array() as array<struct<rule_id:string,scope:string,character:string>>)) rules", "doc_id % 4 = 0 preserve_art_text", "array(cast(doc_id as string)) art_texts",
    )


@registered("r1_compiled_requests", f"""with {_REQUEST} select pg page_id, length(request) length, sha256('{{"compiled_prompt":' || {_QUOTE('request')} || ',"prompt_version":"{m.VERSION}"}}') fingerprint from q""")
def r1_compiled_requests(spark, sf_dir):
    return m.redraw_requests(_specs(spark, sf_dir)).select("page_id", F.length("request").cast("bigint").alias("length"), "fingerprint")


@registered("r3_tampered_requests", """select cast(doc_id as varchar) page_id, case when doc_id % 7 = 0 then 'header_invalid' when doc_id % 7 = 1 then 'version_unsupported' when doc_id % 7 < 4 then 'fingerprint_differs' end fault from documents where doc_id % 7 < 4""")
def r3_tampered_requests(spark, sf_dir):
    made = m.redraw_requests(_specs(spark, sf_dir)).withColumn("k", F.col("page_id").cast("bigint") % 7)
    request = F.when(F.col("k") == 0, F.expr("substring(request, 2)")).when(F.col("k") == 1, F.replace("request", F.lit(m.VERSION), F.lit("other/1"))).when(F.col("k") == 2, F.concat("request", F.lit(" "))).otherwise(F.col("request"))
    recorded = made.select("page_id", request.alias("request"), F.when(F.col("k") == 3, "x").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return m.tampered(recorded, m.VERSION, "page_id")


@registered("r2_text_specs", r"""with b as (select conv_id page, turn pos, coalesce(role, '') sp, coalesce(text, '') t from conversations), n as (select page, string_agg(t, chr(10) order by pos, sp, t) novel from b group by 1), o as (select *, row_number() over w i, coalesce(sum(length(t) + 1) over (partition by page order by pos, sp, t rows between unbounded preceding and 1 preceding), 0) st from b window w as (partition by page order by pos, sp, t)),
    e as (select o.page, i, st, st + length(t) - case when page % 5 = 0 and i = 1 then 1 else 0 end en, length(regexp_replace(t, '\s', '', 'g')) v, t, sp, novel from o join n using (page)), g as (select page, any_value(novel) novel, count(*) c, count(distinct case when page % 7 = 0 then 'b' else 'b' || i end) bal, bool_or(not (st >= 0 and st < en and en <= length(novel))) outside, bool_or(st < en and en <= length(novel) and substr(novel, cast(st as bigint) + 1, cast(en - st as bigint)) <> t) apart, bool_or(v > 25 and sp <> 'system') lng, sum(v) vis from e group by 1)
    select page page_id, unnest(list_filter([case when page % 6 = 0 then 'mode_unknown' end, case when page % 11 = 0 then 'budget_invalid' end, case when page % 9 = 0 then 'novel_hash_differs' end, case when page % 8 = 0 then 'allowed_repeats' end, case when bal < c then 'balloon_repeated' end, case when outside then 'offsets_invalid' end, case when apart then 'slice_differs' end, case when lng then 'over_budget_without_reason' end, case when vis > case when page % 11 = 0 then 0 else 600 end then 'page_over_budget' end], lambda x: x is not null)) fault from g""")
def r2_text_specs(spark, sf_dir):
    pages, blocks = _text_specs(spark, sf_dir)
    return m.text_faults(pages, blocks)


def _text_specs(spark, sf_dir):
    told = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("speaker_id"), F.coalesce("text", F.lit("")).alias("t"))
    order = Window.partitionBy("page_id").orderBy("turn", "speaker_id", "t")
    each = told.withColumn("position", F.row_number().over(order)).withColumn("start", F.coalesce(F.sum(F.length("t") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    blocks = each.selectExpr("page_id", "position", "concat('p', position) panel_id", "if(page_id % 7 = 0, 'b', concat('b', position)) balloon_id", "speaker_id", "t source_text", "t replacement", "start", "start + length(t) - if(page_id % 5 = 0 and position = 1, 1, 0) `end`", "if(speaker_id = 'system', 'by nature', null) reason")
    novels = told.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "speaker_id", "t"))), lambda x: x["t"]), "\n").alias("novel_text"))
    pages = novels.selectExpr("page_id", "'c' cluster_id", "if(page_id % 6 = 0, 'other', if(page_id % 2 = 0, 'page_reset', 'block_replace')) mode", "if(page_id % 11 = 0, 0, 600) budget", "if(page_id % 8 = 0, array('a', 'a'), array('a')) allowed", "if(page_id % 9 = 0, 'x', sha2(novel_text, 256)) novel_hash", "novel_text")
    return pages, blocks


@registered("r2_text_compiled", """with b as (select conv_id page, turn pos, coalesce(role, '') sp, coalesce(text, '') t from conversations) select page page_id, count(*) blocks, true opens, false leaks from b group by 1""")
def r2_text_compiled(spark, sf_dir):
    """The compiled text holds each block once, opens as it should, and has no line of the novel of its own."""
    pages, blocks = _text_specs(spark, sf_dir)
    made = m.text_requests(pages.withColumn("page_id", F.col("page_id").cast("string")), blocks.withColumn("page_id", F.col("page_id").cast("string")))
    count = F.size(F.split("request", '"panel_id":')) - 1
    return made.select(F.col("page_id").cast("bigint").alias("page_id"), count.cast("bigint").alias("blocks"), F.col("fingerprint").isNotNull().alias("opens"), F.contains("request", F.lit("novel_text")).alias("leaks"))


@registered("r5_lock_forms", """select doc_id, unnest(list_filter([case when doc_id % 6 >= 4 then 'lock_form' end, case when doc_id % 6 = 3 or doc_id % 6 = 5 or (doc_id % 6 in (1, 4) and lang is null) then 'lock_category' end, case when doc_id % 6 = 5 or (doc_id % 6 in (0, 1, 4) and coalesce(trim(source), '') = '') or (doc_id % 6 in (2, 3) and n_chars < 150) then 'lock_text' end], lambda f: f is not null)) fault from documents""")
def r5_lock_forms(spark, sf_dir):
    form = lambda *values: f"named_struct({', '.join(f"'{k}', cast({v} as string)" for k, v in zip(('bare', 'category', 'text', 'type', 'value'), values))})"
    style = ("if(lang is null, 'mood', 'style')", "coalesce(source, ' ')")
    forms = [form("coalesce(source, ' ')", *["null"] * 4), form("null", *style, "null", "null"), form("null", "null", "null", "'identity'", "if(n_chars < 150, ' ', 'v')"), form("null", "null", "null", "'other'", "if(n_chars < 150, ' ', 'v')"), form("null", *style, "'identity'", "'v'"), form(*["null"] * 5)]
    lock = f"array(element_at(array({', '.join(forms)}), cast(doc_id % 6 + 1 as int))) locks"
    return m.lock_faults(table(spark, sf_dir, "documents").selectExpr("doc_id", lock), "doc_id")


@registered("r7_art_texts", """with d as (select *, doc_id % 4 a, doc_id % 5 b, n_chars > 500 keep from documents), e as (select *, case a when 0 then null when 1 then 0 else 1 end s, case b when 0 then 1 when 1 then 0 else null end c from d)
    select doc_id, unnest(list_filter([case when s is not null and c is not null then 'two_lists' end, case when coalesce(s, c) = 0 then 'list_empty' end, case when coalesce(keep, false) and coalesce(s, c, 0) = 0 then 'texts_missing' end, case when coalesce(s, c, 0) > 0 and not coalesce(keep, false) then 'keeping_not_asked' end], lambda f: f is not null)) fault from e""")
def r7_art_texts(spark, sf_dir):
    empty = "cast(array() as array<string>)"
    specs = table(spark, sf_dir, "documents").selectExpr("doc_id", "n_chars > 500 preserve_art_text", f"case doc_id % 4 when 0 then null when 1 then {empty} else array('a') end source_art_texts", f"case doc_id % 5 when 0 then array('a') when 1 then {empty} end confirmed_art_texts")
    return m.art_text_faults(specs, "doc_id")


@registered("p11_target_paths", """select page_id, unnest(list_filter([case when page_id % 6 in (0, 1, 2) then 'target_contaminated' end, case when page_id % 6 <> 3 then case when page_id % 6 = 4 then 'target_of_another_page' end end], lambda f: f is not null)) fault from pages""")
def p11_target_paths(spark, sf_dir):
    path = "concat(case page_id % 6 when 0 then 'work/page_candidates/' when 1 then 'Ｒejected\\\\\\\\' when 2 then '人设/' else 'in/' end, if(page_id % 6 = 4, page_id + 1, page_id), '.JPG') path"
    return m.target_faults(table(spark, sf_dir, "pages").selectExpr("page_id id", "cast(page_id as string) page_id", path), "id").withColumnRenamed("id", "page_id")


@registered("r4_reference_contracts", """select doc_id, unnest(list_filter([case when doc_id % 5 = 0 then 'target_not_one' end, case when lang is null then 'adjacent_style_missing' end, case when doc_id % 7 in (0, 1) then 'identity_as_style' end], lambda f: f is not null)) fault from documents""")
def r4_reference_contracts(spark, sf_dir):
    refs = "filter(array(if(doc_id % 5 = 0 and doc_id % 2 = 0, null, struct('t' path, 'target_original' role)), if(doc_id % 5 = 0 and doc_id % 2 = 1, struct('u' path, 'target_original' role), null), if(lang is null, null, struct('a' path, 'adjacent_style' role)), struct('Sheet.png' path, 'identity_only' role), struct(case doc_id % 7 when 0 then 'sheet.PNG' when 1 then 'x/Character-Sheet 2.png' else 'p' end path, 'primary_style' role)), x -> x is not null) `references`"
    return m.reference_faults(table(spark, sf_dir, "documents").selectExpr("doc_id", refs), "doc_id")
