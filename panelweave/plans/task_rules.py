"""Queries over whole task records and the promotion of pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.operators import task_rules as t
from panelweave.registry import EVENTS, registered
from panelweave.sources.shared import dealt
from panelweave.sources.tables import table, task_events

_TIME = "2026-07-13T08:00:00Z"
#: what is changed in every task of a remainder, in a state, and the findings that this leads to
_PLANTED = {
    3: ("queued", {"lease_owner": "'w'"}, ("queued_keeps_lease_owner",)), 5: ("leased", {"lease_owner": "null"}, ("leased_lacks_lease_owner",)), 7: ("completed", {"candidate_hash": "null"}, ("completed_lacks_candidate_hash",)), 9: ("failed", {"failure_code": "' '"}, ("failed_lacks_failure_code",)),
    11: ("completed", {"failed_at": f"'{_TIME}'"}, ("completed_keeps_failed_at",)), 13: (None, {"attempt_count": "-1L"}, ("attempt_count_invalid",)), 15: (None, {"payload_hash": "'other'"}, ("task_id_differs",)), 17: (None, {"queued_at": "'2026-07-13'"}, ("queued_at_without_zone",)),
    19: ("leased", {"is_canary": "true", "cluster_id": "null"}, ("canary_without_cluster", "canary_without_gate")), 21: (None, {"task_type_": "'visual'"}, ("expensive_without_canary",)),
}
_ROWS = """rows_ as (select o_orderkey, min(o_custkey) o_custkey from orders group by 1), ts as (select o_orderkey // 1000 || '' project_id, o_orderkey k, ['queued', 'leased', 'completed', 'failed'][o_custkey % 4 + 1] state, sha256(o_orderkey || '') payload, o_orderkey % 23 r from rows_),
    ids as (select *, case when r = 21 then 'visual' else 'text_repair' end type_, sha256('{"page_id":"' || k || '","payload_hash":"' || payload || '","task_type":"' || case when r = 21 then 'visual' else 'text_repair' end || '"}') task_id from ts)"""
_CASES = ", ".join(f"case when r = {r}{f" and state = '{s}'" if s else ''} then '{f}' end" for r, (s, _, faults) in _PLANTED.items() for f in faults)


@registered("st6_task_faults", f"""with {_ROWS} select project_id, task_id entity, unnest(list_filter([{_CASES}], lambda f: f is not null)) fault from ids""")
def st6_task_faults(spark, sf_dir):
    # dealt while narrow: what Spark merges by these few bytes would be too few tasks for the rules
    held = dealt(table(spark, sf_dir, "orders").selectExpr("cast(floor(o_orderkey / 1000) as string) project_id", "o_orderkey", "o_custkey"))
    rows = held.groupBy("project_id", "o_orderkey").agg(F.min("o_custkey").alias("c")).selectExpr("project_id", "o_orderkey k", "element_at(array('queued', 'leased', 'completed', 'failed'), cast(c % 4 + 1 as int)) state", "o_orderkey % 23 r")
    rows = rows.selectExpr("*", "cast(k as string) page_id", "if(r = 21, 'visual', 'text_repair') task_type", "sha2(cast(k as string), 256) payload_hash", "'c' cluster_id", "cast(null as string) prompt_reference_hash", "1L attempt_count", "false is_canary", "cast(null as string) canary_task_id", "cast(null as string) idempotency_key")
    rows = rows.withColumn("task_id", t.content_hash("page_id", "task_type", "payload_hash"))
    of = lambda state, value: F.when(F.col("state") == state, F.lit(value))
    held = {"created_at": F.lit(_TIME), "updated_at": F.lit(_TIME), "queued_at": F.lit(_TIME), "leased_at": of("leased", _TIME), "completed_at": of("completed", _TIME), "failed_at": of("failed", _TIME), "completed_by": of("completed", "w"), "lease_owner": of("leased", "w"), "lease_expires_at": of("leased", _TIME), "candidate_path": of("completed", "p"), "candidate_hash": of("completed", "h"), "failure_code": of("failed", "style_drift"), "failure_record_id": of("failed", "f")}
    rows = rows.withColumns(held)
    for r, (state, changes, _) in _PLANTED.items():
        here = (F.col("r") == r) & (F.lit(True) if state is None else F.col("state") == state)
        rows = rows.withColumns({c: F.when(here, F.expr(v)).otherwise(F.col(c)) for c, v in changes.items() if not c.endswith("_")})
    rows = rows.withColumn("timestamps", F.struct(*t.TIMES)).withColumn("candidate", F.struct(F.col("candidate_path").alias("path"), F.col("candidate_hash").alias("hash")))
    failed = lambda c: F.when(F.col("state") == "failed", c)
    rows = rows.withColumn("failure", F.struct(F.col("failure_code").alias("code"), F.col("failure_record_id").alias("record_id"), failed(F.col("cluster_id")).alias("cluster_id"), failed(F.col("prompt_reference_hash")).alias("prompt_reference_hash"), failed(F.lit(_TIME)).alias("timestamp")))
    return t.queue_faults(rows, spark.createDataFrame([], t.GATES))


_RANK = "case " + " ".join(f"when state = '{s}' then {i}" for i, s in enumerate(t.PROMOTION, 1)) + " " + " ".join(f"when state = '{s}' then {i}" for s, i in t.SET_BACK.items()) + " end"


@registered("d1_promotion_faults", f"""with {EVENTS}, s as (select project_id, lane page_id, ts, event_id, row_number() over (partition by project_id, lane order by ts, event_id) q from ev), i as (select *, case when q <= 12 then q when (q - 13) % 7 = 0 then 0 else 6 + (q - 13) % 7 end n from s),
    st as (select *, case when event_id % 37 = 0 then 'lost' when event_id % 31 = 0 then 'failed' when n = 0 then 'rework' else {list(t.PROMOTION)}[least(12, n + case when event_id % 29 = 0 then 1 else 0 end)] end state, 'h' || (q // 14) candidate_hash from i),
    r as (select *, {_RANK} "rank", state in {tuple(t.SET_BACK)} back from st), w as (select *, coalesce(last_value("rank" ignore nulls) over (partition by project_id, page_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) was, sum(back::int) over (partition by project_id, page_id order by ts, event_id) turn from r),
    f as (select *, min(turn) over (partition by project_id, page_id, candidate_hash, state) first_ from w)
    select project_id, page_id, event_id, unnest(list_filter([case when "rank" is null then 'state_unknown' end, case when not back and "rank" > was + 1 then 'state_skipped' end, case when not back and "rank" <= was then 'moved_back' end, case when state = 'candidate_ready' and first_ < turn then 'candidate_shown_again' end], lambda x: x is not null)) fault from f""")
def d1_promotion_faults(spark, sf_dir):
    events = task_events(spark, sf_dir).select("project_id", F.col("lane").alias("page_id"), "ts", "event_id")
    rows = events.withColumn("q", F.row_number().over(Window.partitionBy("project_id", "page_id").orderBy("ts", "event_id")))
    rows = rows.withColumn("n", F.expr("case when q <= 12 then q when (q - 13) % 7 = 0 then 0 else 6 + (q - 13) % 7 end"))
    states = f"array({', '.join(repr(s) for s in t.PROMOTION)})"
    state = f"case when event_id % 37 = 0 then 'lost' when event_id % 31 = 0 then 'failed' when n = 0 then 'rework' else element_at({states}, cast(least(12, n + if(event_id % 29 = 0, 1, 0)) as int)) end"
    return t.promotion_faults(rows.withColumn("state", F.expr(state)).withColumn("candidate_hash", F.concat(F.lit("h"), F.floor(F.col("q") / 14))))
