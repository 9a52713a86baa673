"""Queries over tasks as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.columns import content_hash
from panelweave.operators import dispatch
from panelweave.registry import EVENTS, PAGES, registered
from panelweave.sources.tables import evidence_pages, table, task_events

_TASKS = f"""{EVENTS}, held as (select project_id, lane, last(kind order by ts, event_id) l, count(*) filter (kind = 'claim') attempts, min(ts) first_at, arg_min(event_id, (ts, event_id)) first_id, max(ts) filter (kind = 'claim') leased_at, max(ts) filter (kind = 'complete') completed_at, max(ts) filter (kind = 'fail') failed_at from ev group by 1, 2),
    tasks as (select *, case when l in ('add', 'reopen') then 'queued' when l = 'claim' then 'leased' when l = 'complete' then 'completed' when l = 'fail' then 'failed' end state from held)"""


@registered("st6_state_faults", f"""with {_TASKS}, f as (select lane, unnest([case when state = 'queued' and leased_at is not null then 'queued_keeps_lease' end, case when state = 'queued' and (completed_at is not null or failed_at is not null) then 'queued_keeps_end' end, case when state = 'leased' and (completed_at is not null or failed_at is not null) then 'leased_keeps_end' end,
    case when state = 'completed' and failed_at is not null then 'completed_keeps_failure' end, case when state = 'failed' and completed_at is not null then 'failed_keeps_completion' end, case when state in ('completed', 'failed') and leased_at is null then 'ended_without_lease' end]) fault from tasks) select * from f where fault is not null""")
def st6_state_faults(spark, sf_dir):
    return dispatch.state_faults(dispatch.task_rows(task_events(spark, sf_dir)))


@registered("o5_next_tasks", f"""with {_TASKS}, clock as (select project_id, max(ts) t from ev group by 1), busy as (select project_id, count(*) n from tasks join clock using (project_id) where state = 'leased' and leased_at + interval 6 hours > t group by 1),
    q as (select project_id, lane, row_number() over (partition by project_id order by first_at, first_id, lane) place from tasks where state = 'queued') select q.* from q left join busy using (project_id) where place <= 3 - coalesce(n, 0)""")
def o5_next_tasks(spark, sf_dir):
    return dispatch.next_tasks(task_events(spark, sf_dir))


@registered("a5_attempt_metrics", f"""with {_TASKS} select project_id, round(coalesce(count(*) filter (state = 'completed' and attempts <= 1)::double / nullif(count(*) filter (state in ('completed', 'failed')), 0), 0), 6) first_pass_rate, cast(sum(greatest(attempts - 1, 0)) as bigint) retries from tasks group by 1""")
def a5_attempt_metrics(spark, sf_dir):
    return dispatch.attempt_metrics(task_events(spark, sf_dir))


@registered("st4_invalid_completions", f"""with {EVENTS}, t as (select *, lag(kind) over w was, lag(ts) over w since from ev window w as (partition by lane order by ts, event_id)) select lane, event_id, case when was is distinct from 'claim' then 'not_leased' else 'lease_expired' end reason from t where kind = 'complete' and (was is distinct from 'claim' or since + interval 6 hours <= ts)""")
def st4_invalid_completions(spark, sf_dir):
    return dispatch.invalid_completions(task_events(spark, sf_dir))


@registered("st5_approvals", f"""with {EVENTS}, t as (select *, count(*) filter (kind = 'complete') over w done, last_value(case when kind = 'claim' then cache_key % 5 end ignore nulls) over w worker from ev window w as (partition by lane order by ts, event_id rows between unbounded preceding and 1 preceding))
    select lane, event_id, case when done = 0 then 'not_completed' when worker is null then 'no_worker' when worker = cache_key % 5 then 'reviewer_is_worker' else 'approved' end verdict from t where kind = 'reopen'""")
def st5_approvals(spark, sf_dir):
    return dispatch.approvals(task_events(spark, sf_dir).withColumn("actor", F.col("cache_key") % 5))


@registered("p16_task_ids", """select event_id, sha256('{"page_id":"' || user_id || '","payload_hash":"' || sha256(props) || '","task_type":"' || event_type || '"}') task_id, coalesce(cast(user_id % 10 as varchar), 'unknown') || '::' || event_type lane_key from events""")
def p16_task_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("page_id"), F.sha2("props", 256).alias("payload_hash"), F.col("event_type").alias("task_type"), (F.col("user_id") % 10).cast("string").alias("cluster"))
    return rows.select("event_id", content_hash("page_id", "payload_hash", "task_type").alias("task_id"), F.concat_ws("::", F.coalesce("cluster", F.lit("unknown")), "task_type").alias("lane_key"))


@registered("o5_eligible_tasks", f"""with {PAGES}, t as (select project_id, doc_id, pos // 2 page, (pos - 1) // 10 c, doc_id % 3 = 0 dear, case when doc_id % 17 = 0 then 'leased' when doc_id % 5 = 0 then 'completed' else 'queued' end s, coalesce(n_chars > 500, false) live, lang is null bad from pg),
    g as (select project_id, c, min(doc_id) canary, max(doc_id) % 2 = 0 ok, bool_or(bad and dear) p1, bool_or(bad and not dear) p0 from t group by 1, 2), l as (select distinct project_id, page from t where s = 'leased' and live), y as (select project_id, count(*) n from t where s = 'leased' and live group by 1),
    e as (select t.*, row_number() over (partition by t.project_id, t.page order by doc_id) o from t join g using (project_id, c) where s = 'queued' and not (case when dear then p1 else p0 end) and not exists (select 1 from l where l.project_id = t.project_id and l.page = t.page) and (not dear or ok or canary = doc_id)),
    q as (select project_id, doc_id task_id, row_number() over (partition by project_id order by doc_id) place from e where o = 1) select q.* from q left join y using (project_id) where place <= 3 - coalesce(n, 0)""")
def o5_eligible_tasks(spark, sf_dir):
    tasks = evidence_pages(spark, sf_dir).selectExpr("project_id", "doc_id task_id", "doc_id seq", "floor(pos / 2) page_id", "floor((pos - 1) / 10) cluster_id", "doc_id % 3 = 0 expensive", "case when doc_id % 17 = 0 then 'leased' when doc_id % 5 = 0 then 'completed' else 'queued' end state", "coalesce(n_chars > 500, false) live", "lang is null bad")
    tasks = tasks.withColumn("lane", F.concat_ws("::", "cluster_id", F.col("expensive").cast("string")))
    canaries = tasks.groupBy("project_id", "cluster_id").agg(F.min("task_id").alias("task_id"), (F.max("task_id") % 2 == 0).alias("approved"))
    return dispatch.eligible_tasks(tasks, tasks.filter("bad").select("project_id", "lane").distinct(), canaries)


@registered("a7_retries_by_code", f"""with {EVENTS}, t as (select *, coalesce(sum(case when kind in ('complete', 'fail') then 1 else 0 end) over (partition by lane order by ts, event_id rows between unbounded preceding and 1 preceding), 0) turn from ev), k as (select *, count(*) filter (kind = 'claim') over (partition by lane, turn) c from t)
    select project_id, code, count(*) failures, cast(sum(greatest(c - 1, 0)) as bigint) retries from k where kind = 'fail' group by 1, 2""")
def a7_retries_by_code(spark, sf_dir):
    return dispatch.retries_by_code(task_events(spark, sf_dir))
