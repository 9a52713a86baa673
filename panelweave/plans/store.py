"""Queries of the learning store: lineitem rows as reviewed failures, the rules and events that they promote, and a store with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import audits, store
from panelweave.registry import registered
from panelweave.sources.shared import dealt, written
from panelweave.sources.tables import table

_CODES = [[audits.CODES[i], audits.CODES[i + 2]] for i in range(3)]
_q = lambda x: f"coalesce('\"' || {x} || '\"', 'null')"
_l = lambda x: f"case when len({x}) = 0 then '[]' else '[\"' || array_to_string({x}, '\",\"') || '\"]' end"


def _json(**fields: str) -> str:
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in sorted(fields.items())) + " || '}'"


def _rule_sql(source: str, scope: str, page: str, cluster: str) -> str:
    """A CTE body: rules of one scope with their ids, from rows of signature, character, codes, action, sources, reviewer and time."""
    key = f"sha256({_json(scope=f"'\"{scope}\"'", signature=_q('signature'), page_id=_q(page) if scope == 'page' else "'null'", cluster_id=_q(cluster) if scope == 'cluster' else "'null'", character=_q('ch'))})"
    keyed = f"(select *, {key} semantic_key from {source})"
    made = _json(semantic_key=_q("semantic_key"), scope=f"'\"{scope}\"'", signature=_q("signature"), page_id=_q(page), cluster_id=_q(cluster), character=_q("ch"), codes=_l("codes"), corrective_action=_q("action"), source_failure_ids=_l("sf"), source_outcome_ids=_l("so"), source_rule_ids=_l("sr"), promoted_by=_q("by_"), promoted_at=_q("at_"))
    return f"select *, '{scope}' \"scope\", cast({page} as varchar) page_id, cast({cluster} as varchar) cluster_id, 'rule-' || sha256({made}) rule_id from {keyed}"


_FAILURES = f"""fl as (select l_orderkey // 5000 || '' project_id, 'f-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || l_returnflag || l_linestatus || case when l_quantity > 48 and l_discount >= 0.09 then '+' else '-' end fid, l_orderkey || '' pg, 'c' || l_suppkey cl, l_linestatus ch, {_CODES}[case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end] codes, 'redo ' || l_returnflag action, 'r' || l_partkey % 7 by_, '2026-07-' || lpad(cast(l_linenumber + 10 as varchar), 2, '0') || 'T08:00:00Z' at_, l_quantity > 48 and l_discount >= 0.09 helped from lineitem),
    fs as (select distinct *, sha256({_json(codes=_l('codes'), corrective_action=_q('action'))}) signature, 'o-' || fid oid from fl where helped)"""
_RULES = f"""{_FAILURES}, p0 as (select project_id, signature, ch, pg, arg_min(cl, fid) cl, arg_min(codes, fid) codes, arg_min(action, fid) action, [min(fid)] sf, ['o-' || min(fid)] so, cast([] as varchar[]) sr, arg_min(by_, fid) by_, arg_min(at_, fid) at_ from fs group by 1, 2, 3, 4), p as ({_rule_sql('p0', 'page', 'pg', 'cl')}),
    c0 as (select project_id, signature, ch, cl, arg_min(codes, sf[1]) codes, arg_min(action, sf[1]) action, list_sort(list_distinct(flatten(list(sf)))) sf, list_sort(list_distinct(flatten(list(so)))) so, list_sort(list(distinct rule_id)) sr, arg_min(by_, sf[1]) by_, arg_min(at_, sf[1]) at_ from p group by 1, 2, 3, 4 having count(distinct pg) >= 2), c as ({_rule_sql('c0', 'cluster', 'null', 'cl')}),
    j0 as (select project_id, signature, ch, arg_min(codes, sf[1]) codes, arg_min(action, sf[1]) action, list_sort(list_distinct(flatten(list(sf)))) sf, list_sort(list_distinct(flatten(list(so)))) so, list_sort(list(distinct rule_id)) sr, arg_min(by_, sf[1]) by_, arg_min(at_, sf[1]) at_ from c group by 1, 2, 3 having count(distinct cl) >= 2), j as ({_rule_sql('j0', 'project', 'null', 'null')}),
    s0 as (select project_id, signature, ch, codes, action, sf, so, [rule_id] sr, by_, at_ from j), s as ({_rule_sql('s0', 'skill_candidate', 'null', 'null')}),
    rl as ({' union all '.join(f'select project_id, rule_id, semantic_key, "scope", signature, page_id, cluster_id, ch, codes, action, sf, so, sr, by_, at_ from {x}' for x in 'pcjs')})"""
_EVENT = _json(event_type="'\"promoted\"'", rule_id=_q("rule_id"), **{"from": _q("f"), "to": _q('"scope"')}, from_scope=_q("f"), to_scope=_q('"scope"'), evidence_ids=_l("case when len(sr) > 0 then sr else so end"), reviewer=_q("by_"), timestamp=_q("at_"), reason="'null'")


def _failures(spark, sf_dir, deal=dealt):
    """lineitem rows as failures, dealt by project. deal: how; what is promoted is few rows, which Spark may put into fewer partitions."""
    # what tells rows apart, dealt by project while narrow; a row without an id is told by what else is said of its part
    whole = " and ".join(f"{c} is not null" for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))
    rows = deal(table(spark, sf_dir, "lineitem").selectExpr("cast(floor(l_orderkey / 5000) as string) project_id", "l_orderkey", "l_linenumber", f"if({whole}, l_partkey, l_partkey % 7) l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity > 48 and l_discount >= 0.09 effective")).distinct()
    lists = [f"array('{a}', '{b}')" for a, b in _CODES]
    made = rows.selectExpr(
        "project_id", "concat('f-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, l_returnflag, l_linestatus, if(effective, '+', '-')) failure_id", "cast(l_orderkey as string) page_id", "concat('c', l_suppkey) cluster_id", "l_linestatus character", f"case l_returnflag when 'A' then {lists[0]} when 'N' then {lists[1]} else {lists[2]} end codes",
        "concat('redo ', l_returnflag) corrective_action", "effective", "'reviewed' status", "concat('o-f-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, l_returnflag, l_linestatus, if(effective, '+', '-')) outcome_id", "concat('r', l_partkey % 7) reviewed_by", "concat('2026-07-', lpad(cast(l_linenumber + 10 as string), 2, '0'), 'T08:00:00Z') reviewed_at",
    )
    return made.withColumn("signature", store.signature())


def _promoted(spark, sf_dir):
    return written(store.promoted_rules(_failures(spark, sf_dir, lambda rows: rows.repartition("project_id"))))


@registered("a17_rule_records", f"""with {_RULES}, e as (select *, case "scope" when 'page' then 'observed' when 'cluster' then 'page' when 'project' then 'cluster' else 'project' end f from rl)
    select project_id, rule_id, semantic_key, "scope", signature, page_id, cluster_id, ch "character", array_to_string(sf, ',') source_failures, array_to_string(sr, ',') source_rules, 'event-' || sha256({_EVENT}) event_id from e""")
def a17_rule_records(spark, sf_dir):
    rules = _promoted(spark, sf_dir)
    events = store.promotion_events(rules).select("project_id", "rule_id", "event_id")
    return rules.join(events, ["project_id", "rule_id"]).select("project_id", "rule_id", "semantic_key", "scope", "signature", "page_id", "cluster_id", "character", F.array_join("source_failure_ids", ",").alias("source_failures"), F.array_join("source_rule_ids", ",").alias("source_rules"), "event_id")


@registered("j13_rules_in_order", f"""with {_RULES}, q as (select distinct l_orderkey // 5000 || '' project_id, l_orderkey || '' pg, 'c' || l_suppkey cl, l_linestatus ch, {_CODES}[case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end] codes from lineitem),
    m as (select q.*, rl.rule_id, rl."scope", case rl."scope" when 'page' then 1 when 'cluster' then 2 when 'project' then 3 else 4 end k from q join rl on rl.project_id = q.project_id and rl.ch = q.ch and len(list_intersect(rl.codes, q.codes)) > 0 and case rl."scope" when 'page' then rl.page_id = q.pg when 'cluster' then rl.cluster_id = q.cl else true end)
    select project_id, pg || '/' || cl || '/' || ch || '/' || codes[1] request, rule_id, "scope", cast(row_number() over (partition by project_id, pg, cl, ch, codes order by k, rule_id) as int) place from m""")
def j13_rules_in_order(spark, sf_dir):
    lists = [f"array('{a}', '{b}')" for a, b in _CODES]
    told = dealt(table(spark, sf_dir, "lineitem").selectExpr("cast(floor(l_orderkey / 5000) as string) project_id", "l_orderkey", "l_suppkey", "l_linestatus", "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end kind")).distinct()
    asked = told.selectExpr("project_id", "cast(l_orderkey as string) page_id", "concat('c', l_suppkey) cluster_id", "l_linestatus character", f"array({', '.join(lists)})[kind] codes")
    asked = asked.withColumn("request", F.concat_ws("/", "page_id", "cluster_id", "character", F.col("codes")[0]))
    return store.applicable_rules(_promoted(spark, sf_dir).withColumn("revoked", F.lit(False)), asked, "request")


@registered("g4_rule_record_faults", f"""with {_RULES}, x as (select *, ('0x' || substr(rule_id, 6, 6))::bigint h from rl)
    select project_id, rule_id, unnest(list_filter([case when h % 5 = 0 then 'signature_differs' end, case when h % 5 = 0 then 'semantic_key_differs' end, case when h % 7 = 0 and "scope" = 'page' then 'place_missing' end, case when h % 7 = 0 and "scope" = 'page' and h % 5 <> 0 then 'semantic_key_differs' end,
        case when h % 11 = 0 then 'promotion_unsigned' end, case when h % 5 = 0 or h % 7 = 0 and "scope" = 'page' or h % 11 = 0 then 'rule_id_differs' end, case when h % 3 = 0 then 'state_differs' end], lambda f: f is not null)) fault from x""")
def g4_rule_record_faults(spark, sf_dir):
    failures = _failures(spark, sf_dir)
    rules = _promoted(spark, sf_dir).withColumn("h", F.conv(F.substring("rule_id", 6, 6), 16, 10).cast("bigint"))
    rules = rules.withColumn("signature", F.expr("if(h % 5 = 0, 'x', signature)")).withColumn("page_id", F.expr("if(h % 7 = 0, null, page_id)")).withColumn("promoted_by", F.expr("if(h % 11 = 0, ' ', promoted_by)"))
    rules = rules.selectExpr("*", "h % 2 = 0 revoked", "(h % 2 = 1) = (h % 3 <> 0) effective", "if(h % 2 = 0, 'why', null) revocation_reason", "if(h % 2 = 0, 'me', null) revoked_by", "if(h % 2 = 0, '2026-07-20T08:00:00Z', null) revoked_at")
    return store.rule_faults(rules, failures)


@registered("g6_store_faults", f"""with {_RULES}, x as (select *, ('0x' || substr(rule_id, 6, 6))::bigint h from rl), gone as (select project_id, rule_id from x where "scope" = 'page' and h % 4 = 0), y as (select x.*, case when "scope" = 'page' then h % 4 = 0 else false end revoked, exists (select 1 from gone g where g.project_id = x.project_id and list_contains(x.sr, g.rule_id)) fallen from x)
    select project_id, rule_id, unnest(list_filter([case when fallen then 'active_on_revoked_source' end, case when h % 9 = 0 then 'promotions_not_one' end, case when revoked and h % 8 <> 0 then 'revocations_differ' end, case when h % 13 = 0 and h % 9 <> 0 then 'event_id_differs' end, case when h % 13 = 0 and h % 9 <> 0 then 'event_differs' end], lambda f: f is not null)) fault from y""")
def g6_store_faults(spark, sf_dir):
    failures = _failures(spark, sf_dir)
    rules = _promoted(spark, sf_dir).withColumn("h", F.conv(F.substring("rule_id", 6, 6), 16, 10).cast("bigint")).withColumn("revoked", F.expr("scope = 'page' and h % 4 = 0"))
    rules = rules.selectExpr("*", "not revoked effective", "if(revoked, 'why', null) revocation_reason", "if(revoked, 'me', null) revoked_by", "if(revoked, '2026-07-20T08:00:00Z', null) revoked_at")
    promotions = store.promotion_events(rules).join(rules.select("project_id", "rule_id", "h"), ["project_id", "rule_id"]).filter("h % 9 <> 0").withColumn("reviewer", F.expr("if(h % 13 = 0, 'x', reviewer)")).drop("h")
    down = rules.filter("revoked and h % 8 = 0").selectExpr("project_id", "rule_id", "'revoked' event_type", "scope `from`", "'revoked' `to`", "scope from_scope", "'revoked' to_scope", "array(rule_id) evidence_ids", "revoked_by reviewer", "revoked_at timestamp", "revocation_reason reason").withColumn("event_id", store.event_id())
    return store.store_faults(rules, failures, promotions.unionByName(down))


def _withdrawals(rules):
    """Page rules by every fourth id and cluster rules by every seventh are withdrawn."""
    h = F.conv(F.substring("rule_id", 6, 6), 16, 10).cast("bigint")
    told = rules.withColumn("h", h).filter("scope = 'page' and h % 4 = 0 or scope = 'cluster' and h % 7 = 0")
    return told.selectExpr("project_id", "rule_id", "concat('why ', h % 3) reason", "concat('r', h % 5) reviewed_by", "concat('2026-08-', lpad(cast(1 + h % 28 as string), 2, '0'), 'T08:00:00Z') reviewed_at")


def standing(rules):
    return rules.selectExpr("*", "true effective", "false revoked", "cast(null as string) revocation_reason", "cast(null as string) revoked_by", "cast(null as string) revoked_at")


_DOWN = _json(event_type="'\"revoked\"'", rule_id=_q("rule_id"), **{"from": _q('"scope"')}, to="'\"revoked\"'", from_scope=_q('"scope"'), to_scope="'\"revoked\"'", evidence_ids=_l("[rule_id]"), reviewer=_q("by_"), timestamp=_q("at_"), reason=_q("why"))


@registered("g2_revocations", f"""with recursive {_RULES}, x as (select *, ('0x' || substr(rule_id, 6, 6))::bigint h from rl),
    w as (select project_id, rule_id, 'why ' || h % 3 why, 'r' || h % 5 by_, '2026-08-' || lpad(cast(1 + h % 28 as varchar), 2, '0') || 'T08:00:00Z' at_ from x where "scope" = 'page' and h % 4 = 0 or "scope" = 'cluster' and h % 7 = 0),
    edge as (select project_id, rule_id, unnest(sr) source from rl), reach as (select project_id, rule_id, rule_id root from w union select e.project_id, e.rule_id, root from edge e join reach on reach.project_id = e.project_id and reach.rule_id = e.source),
    hit as (select reach.project_id, reach.rule_id, arg_min(struct_pack(why, by_, at_), (at_, root)) s from reach join w on w.project_id = reach.project_id and w.rule_id = root group by 1, 2),
    d as (select project_id, rule_id, "scope", s.why why, s.by_ by_, s.at_ at_ from hit join (select project_id, rule_id, "scope" from rl) using (project_id, rule_id))
    select project_id, rule_id, "scope", why revocation_reason, by_ revoked_by, at_ revoked_at, 'event-' || sha256({_DOWN}) event_id from d""")
def g2_revocations(spark, sf_dir):
    rules = standing(_promoted(spark, sf_dir))
    changed = written(store.revoked(rules, _withdrawals(rules)))
    return changed.join(store.revocation_events(changed).select("project_id", "rule_id", "event_id"), ["project_id", "rule_id"]).select("project_id", "rule_id", "scope", "revocation_reason", "revoked_by", "revoked_at", "event_id")


def _evidence(spark, sf_dir):
    """lineitem rows as recorded failures, and the outcomes that reviewers give for them: every fifth unsigned, every seventh of the same candidate."""
    lists = [f"array('{a}', '{b}')" for a, b in _CODES]
    # what tells rows apart, dealt by project while narrow: no row's texts and hashes are shuffled
    seen = table(spark, sf_dir, "lineitem").selectExpr("cast(floor(l_orderkey / 5000) as string) project_id", "l_orderkey", "if(l_orderkey is null, null, l_linenumber) l_linenumber", "l_suppkey", "l_linestatus", "l_returnflag", "l_partkey", "l_quantity > 25 helped")
    rows = dealt(seen).distinct().selectExpr(
        "project_id", "concat(l_orderkey, '-', l_linenumber) page_id", "concat('c', l_suppkey) cluster_id", "l_linestatus character", f"case l_returnflag when 'A' then {lists[0]} when 'N' then {lists[1]} else {lists[2]} end codes", "concat('seen ', l_partkey) diagnosis", "concat('redo ', l_returnflag) corrective_action",
        "named_struct('path', concat('b/', l_orderkey), 'hash', sha2(concat(l_orderkey, ':', l_linenumber), 256)) before_candidate", "cast(null as string) prompt_reference_hash", "'2026-07-01T08:00:00Z' created_at", "l_orderkey k", "l_partkey part", "helped",
    )
    failures = rows.withColumn("failure_id", store.failure_id())
    outcomes = failures.selectExpr("project_id", "failure_id", "named_struct('path', concat('a/', k), 'hash', if(part % 7 = 0, before_candidate.hash, sha2(concat('after', failure_id), 256))) after_candidate", "helped effective", "if(part % 5 = 0, ' ', concat('r', part % 3)) reviewed_by", "'2026-07-09T08:00:00Z' reviewed_at")
    empty = failures.selectExpr("project_id", "failure_id", "before_candidate", "cast(null as struct<path:string,hash:string>) after_candidate", "cast(null as boolean) effective", "'open' status", "cast(null as string) outcome_id", "cast(null as string) reviewed_by", "cast(null as string) reviewed_at")
    return empty, outcomes


_FAILED = _json(page_id=_q("pg"), cluster_id=_q("cl"), character=_q("ch"), codes=_l("codes"), diagnosis=_q("seen"), corrective_action=_q("act"), before_candidate="'{\"hash\":\"' || bh || '\",\"path\":\"' || bp || '\"}'", prompt_reference_hash="'null'", created_at="'\"2026-07-01T08:00:00Z\"'")
_SEEN = _json(failure_id=_q("fid"), after_candidate="'{\"hash\":\"' || ah || '\",\"path\":\"a/' || k || '\"}'", effective="cast(helped as varchar)", reviewed_by=_q("by_"), reviewed_at="'\"2026-07-09T08:00:00Z\"'")


@registered("p15_recorded_outcomes", f"""with r as (select distinct l_orderkey // 5000 || '' project_id, l_orderkey || '-' || l_linenumber pg, 'c' || l_suppkey cl, l_linestatus ch, {_CODES}[case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end] codes, 'seen ' || l_partkey seen, 'redo ' || l_returnflag act, 'b/' || l_orderkey bp, sha256(l_orderkey || ':' || l_linenumber) bh, l_orderkey k, l_partkey part, l_quantity > 25 helped from lineitem),
    f as (select *, 'failure-' || sha256({_FAILED}) fid from r), o as (select *, case when part % 7 = 0 then bh else sha256('after' || fid) end ah, 'r' || part % 3 by_ from f)
    select project_id, fid failure_id, case when part % 7 = 0 then 'candidate_unchanged' when part % 5 = 0 then 'review_unsigned' end fault, case when part % 7 <> 0 and part % 5 <> 0 then 'reviewed' else 'open' end status, case when part % 7 <> 0 and part % 5 <> 0 then 'outcome-' || sha256({_SEEN}) end outcome_id from o""")
def p15_recorded_outcomes(spark, sf_dir):
    return store.judged_outcomes(*_evidence(spark, sf_dir)).filter("known").select("project_id", "failure_id", "fault", "status", "outcome_id")
