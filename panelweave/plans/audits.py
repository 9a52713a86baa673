"""Queries that audit the learning store."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import audits
from panelweave.registry import registered
from panelweave.sources.tables import table

_NAMES = list(audits.CODES) + [" style_drift ", "unlisted"]


@registered("p13_failure_codes", f"""with c as (select l_orderkey page, list_sort(list(distinct trim({_NAMES}[l_partkey % 10 + 1]))) codes from lineitem group by 1) select page, array_to_string(codes, ',') codes, len(list_filter(codes, lambda x: x = 'unlisted')) unknown from c""")
def p13_failure_codes(spark, sf_dir):
    named = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("l_partkey") % 10 + 1).cast("int"))
    codes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(audits.sorted_codes(F.collect_set(named)).alias("codes"))
    return codes.select("page", F.array_join("codes", ",").alias("codes"), F.size(audits.unknown_codes(F.col("codes"))).cast("bigint").alias("unknown"))


@registered("g1_record_conflicts", "select l_orderkey * 10 + l_linenumber failure_id, count(*) copies, count(distinct l_partkey || '/' || l_suppkey) bodies from lineitem group by 1 having count(distinct l_partkey || '/' || l_suppkey) > 1")
def g1_record_conflicts(spark, sf_dir):
    return audits.record_conflicts(table(spark, sf_dir, "lineitem").withColumn("failure_id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "failure_id", "l_partkey", "l_suppkey")


@registered("j19_outcome_states", """with o as (select l_orderkey k, count(distinct l_linestatus) n, min(l_linestatus) a from lineitem group by 1) select o_orderkey failure_id, case when coalesce(n, 0) = 0 then 'observed' when n > 1 then 'conflict' when a = o_orderstatus then 'unchanged' else 'reviewed' end state from orders left join o on k = o_orderkey""")
def j19_outcome_states(spark, sf_dir):
    failures = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("failure_id"), F.col("o_orderstatus").alias("before"))
    return audits.outcome_states(failures, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("failure_id"), F.col("l_linestatus").alias("after")), "failure_id")


@registered("g5_chain_faults", """with s as (select o_custkey k, count(distinct o_orderkey) n, bool_or(left(o_orderpriority, 1) is distinct from cast(c_nationkey % 5 + 1 as varchar)) d, bool_or(o_orderstatus = 'F') f from orders join customer on o_custkey = c_custkey group by 1), r as (select c_custkey rule_id, c_acctbal > 0 active, coalesce(n, 0) n, d, f from customer left join s on k = c_custkey)
    select rule_id, 'too_few_sources' fault from r where n < 2 union all select rule_id, 'signature_differs' from r where d union all select rule_id, 'active_on_revoked_source' from r where f and active""")
def g5_chain_faults(spark, sf_dir):
    held = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rule_id"), (F.col("c_nationkey") % 5 + 1).cast("string").alias("signature"), (F.col("c_acctbal") > 0).alias("active"))
    sources = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rule_id"), F.substring("o_orderpriority", 1, 1).alias("signature"), F.col("o_orderkey").alias("place"), (F.col("o_orderstatus") == "F").alias("revoked"))
    return audits.chain_faults(held, sources)


@registered("a21_event_faults", """with e as (select l_orderkey k, count(*) filter (l_linestatus = 'O') p, count(*) filter (l_linestatus = 'F') r from lineitem group by 1), b as (select o_orderkey rule_id, o_orderstatus = 'F' revoked, coalesce(p, 0) promotions, coalesce(r, 0) revocations from orders left join e on k = o_orderkey) select rule_id, promotions, revocations from b where promotions <> 1 or revocations <> cast(revoked as int)""")
def a21_event_faults(spark, sf_dir):
    held = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rule_id"), (F.col("o_orderstatus") == "F").alias("revoked"))
    return audits.event_faults(held, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rule_id"), F.when(F.col("l_linestatus") == "O", "promotion").otherwise("revocation").alias("event_type")))


@registered("d5_revoked_in_use", "select distinct l_orderkey page, l_suppkey rule_id from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal < 0)")
def d5_revoked_in_use(spark, sf_dir):
    return audits.revoked_in_use(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("rule_id")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rule_id"), (F.col("s_acctbal") < 0).alias("revoked")))


@registered("d6_regression_gates", """with c as (select p_brand signature, l_returnflag = 'R' and l_quantity > 49 and l_discount > 0.08 failing from lineitem join part on p_partkey = l_partkey) select signature, count(*) "rows", count(*) filter (failing) failing, count(*) filter (failing) = 0 promotable from c group by 1""")
def d6_regression_gates(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return audits.regression_gate(joined.select(F.col("p_brand").alias("signature"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49) & (F.col("l_discount") > 0.08)).alias("failing")))


@registered("g3_failure_faults", f"""with c as (select o_orderkey failure_id, list_transform([o_custkey % 9, o_orderkey % 9], lambda i: {_NAMES[:8] + ['unlisted']}[i + 1]) codes, case o_orderstatus when 'O' then 'observed' when 'F' then 'reviewed' else 'closed' end status, o_custkey % 3 b, case when o_orderkey % 2 = 0 then o_orderkey % 3 end a, case when o_orderkey % 4 = 0 then 'r' end reviewer from orders)
    select failure_id, unnest(list_filter([case when list_contains(codes, 'unlisted') then 'codes_unknown' end, case when codes <> list_sort(list_distinct(codes)) then 'codes_not_canonical' end, case when status = 'observed' and (a is not null or reviewer is not null) then 'observed_with_outcome' end, case when status = 'reviewed' and (a is null or reviewer is null) then 'reviewed_without_outcome' end, case when status = 'reviewed' and a = b then 'candidate_unchanged' end, case when status = 'closed' then 'status_value' end], lambda x: x is not null)) fault from c""")
def g3_failure_faults(spark, sf_dir):
    names = F.array(*map(F.lit, _NAMES[:8] + ["unlisted"]))
    code = lambda c: F.element_at(names, (F.col(c) % 9 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "O", "observed").when(F.col("o_orderstatus") == "F", "reviewed").otherwise("closed")
    key = F.col("o_orderkey")
    failures = table(spark, sf_dir, "orders").select(key.alias("failure_id"), F.array(code("o_custkey"), code("o_orderkey")).alias("codes"), status.alias("status"), (F.col("o_custkey") % 3).alias("before"), F.when(key % 2 == 0, key % 3).alias("after"), F.when(key % 4 == 0, "r").alias("reviewer"))
    return audits.failure_faults(failures)
