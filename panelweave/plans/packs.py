"""Queries over reference packs, preflights and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.text import contaminated, inside, normal_path, zoned_time
from panelweave.operators import packs, preflight
from panelweave.registry import STORY, balanced_sql, registered
from panelweave.sources.tables import story_pages, table

_REFS = f"""{STORY}, dealt as (select *, coalesce(project_id, '') || '#' || {balanced_sql('pos', 'total', 12)} cluster_id from story),
    around as (select *, list_distinct(list_filter([lag(cluster_id) over w, lag(cluster_id, 2) over w, lead(cluster_id) over w, lead(cluster_id, 2) over w], lambda x: x is not null and x <> cluster_id)) near from dealt window w as (partition by project_id order by pos)),
    refs as (select project_id, cluster_id, 'pages/' || first(page_id order by coalesce(risk, -1) desc, pos) || '.jpg' path, 'primary_style' role from dealt group by 1, 2
        union all select project_id, unnest(near), 'pages/' || page_id || '.jpg', 'adjacent_style' from around
        union all select a.project_id, cluster_id, 'identity/' || lower(location) || '.png', 'identity_only' from (select distinct project_id, cluster_id from dealt) a join (select distinct project_id, location from story where location is not null) b on a.project_id is not distinct from b.project_id)"""


def _references(spark, sf_dir):
    return packs.references(packs.dealt_clusters(story_pages(spark, sf_dir)))


@registered("j16_pack_references", f"with {_REFS} select cluster_id, role, count(*) refs, min(path) first_path, max(path) last_path from refs group by 1, 2")
def j16_pack_references(spark, sf_dir):
    return _references(spark, sf_dir).groupBy("cluster_id", "role").agg(F.count("*").alias("refs"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


@registered("a18_reference_packs", f"""with {_REFS}, m as (select cluster_id, count(distinct path || '|' || role) n_references, '[' || string_agg(distinct '{{"path":"' || path || '","role":"' || role || '"}}', ',' order by '{{"path":"' || path || '","role":"' || role || '"}}') || ']' j from refs group by 1),
    i as (select *, sha256('{{"cluster_id":"' || cluster_id || '","references":' || j || '}}') reference_pack_id from m) select cluster_id, n_references, reference_pack_id, sha256('{{"reference_pack_id":"' || reference_pack_id || '","references":' || j || '}}') binding_hash from i""")
def a18_reference_packs(spark, sf_dir):
    return packs.packs(_references(spark, sf_dir))


@registered("r4_pack_faults", f"""with {_REFS}, g as (select cluster_id, count(*) filter (role = 'primary_style') p, count(*) filter (role = 'adjacent_style') a from refs group by 1)
    select cluster_id, 'primary_style_not_one' fault from g where p <> 1 union all select cluster_id, 'adjacent_style_missing' from g where a = 0""")
def r4_pack_faults(spark, sf_dir):
    return packs.pack_faults(_references(spark, sf_dir))


@registered("j17_binding_conflicts", "select source cluster_id, count(distinct lang) packs from documents where source is not null group by 1 having count(distinct lang) > 1")
def j17_binding_conflicts(spark, sf_dir):
    bindings = table(spark, sf_dir, "documents").filter("source is not null").select(F.col("source").alias("cluster_id"), F.col("lang").alias("reference_pack_id"))
    return packs.binding_conflicts(bindings)


@registered("p9_reference_paths", r"""with p as (select page_id, rtrim(lower(regexp_extract(url, '^[a-z]+://(.*)$', 1)), '/') path from pages) select page_id, nullif(path, '') path, regexp_matches(replace(replace(path, '-', '_'), ' ', '_'), '人物参考图|人设|identity_sheet|identity_reference|character_sheet|character_reference|page_candidates/|rejected') contaminated, starts_with(path, split_part(path, '/', 1) || '/') inside from p where path <> ''""")
def p9_reference_paths(spark, sf_dir):
    told = table(spark, sf_dir, "pages").select("page_id", normal_path(F.regexp_extract("url", "^[a-z]+://(.*)$", 1)).alias("path")).filter("path is not null")
    return told.select("page_id", "path", contaminated(F.col("path")).alias("contaminated"), inside(F.col("path"), F.split_part(F.col("path"), F.lit("/"), F.lit(1))).alias("inside"))


@registered("p12_zoned_times", """select event_id, case event_id % 3 when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 1 then strftime(ts - interval 2 hours, '%Y-%m-%d %H:%M:%S') end utc from events""")
def p12_zoned_times(spark, sf_dir):
    spelled = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(F.array(F.lit("Z"), F.lit("+02:00"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(F.to_utc_timestamp(zoned_time(spelled), F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("utc"))


_SCALE, _EDGE = 255, 24.0


def _pairs(spark, sf_dir):
    """Neighbouring vectors as candidate and original; the last has no original."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * _SCALE).alias("v")).filter("v is not null")
    seen = v.select("vec_id", "label", F.size("v").alias("n"), preflight.vector_metrics(F.col("v"), _EDGE).alias("m"))
    after = seen.select((F.col("vec_id") - 1).alias("vec_id"), F.col("n").alias("n2"), F.col("m").alias("m2"))
    apart = lambda f: F.round(F.abs(F.col("m")[f] - F.col("m2")[f]), 6)
    both = seen.join(after, "vec_id", "left")
    return both.select(
        "vec_id", F.lit(True).alias("candidate_ok"), F.col("m2").isNotNull().alias("original_ok"), (F.col("n") == 64).alias("same_size"), F.col("m.variance").alias("variance"), apart("edges").alias("edge_delta"), apart("mean").alias("mean_delta"), apart("std").alias("std_delta"),
        F.when(F.col("label") % 2 == 0, "textless").otherwise("preserve_text").alias("policy"), F.when(F.col("label") % 3 != 0, F.col("label") % 3 == 1).alias("ocr_ok"),
    )


def _stats(name: str) -> str:
    return f"list_avg({name}) mean, list_stddev_pop({name}) std, list_sum(list_transform(range(2, len({name}) + 1), lambda i: case when abs({name}[i] - {name}[i - 1]) > {_EDGE} then 1 else 0 end)) / greatest(len({name}) - 1, 1) edges"


_PREFLIGHT = f"""v as (select vec_id, label, list_transform(embedding, lambda x: x::double * {_SCALE}) v from embeddings where embedding is not null), s as (select vec_id, label, len(v) n, {_stats('v')} from v),
    p as (select a.vec_id, a.label, a.n, a.std * a.std variance, b.vec_id is not null ok, round(abs(a.edges - b.edges), 6) e, round(abs(a.mean - b.mean), 6) m, round(abs(a.std - b.std), 6) d from s a left join s b on b.vec_id = a.vec_id + 1),
    g as (select vec_id, [case when ok then 'pass' else 'fail' end, case when n = 64 then 'pass' else 'fail' end, case when variance >= 20 then 'pass' else 'fail' end, case when e is null then 'blocked' when e <= 0.12 then 'pass' else 'fail' end, case when m is null then 'blocked' when m <= 20 then 'pass' else 'fail' end, case when d is null then 'blocked' when d <= 15 then 'pass' else 'fail' end,
        case when label % 2 <> 0 then 'not_applicable' when label % 3 = 0 then 'blocked' when label % 3 = 1 then 'pass' else 'fail' end] c from p),
    pre as (select vec_id, array_to_string(c, ',') checks, case when list_contains(c, 'fail') then 'fail' when list_contains(c, 'blocked') then 'blocked' else 'pass' end status from g)"""


@registered("m1_preflight", f"with {_PREFLIGHT} select * from pre")
def m1_preflight(spark, sf_dir):
    return preflight.preflight(_pairs(spark, sf_dir)).select("vec_id", F.array_join(F.col("checks.status"), ",").alias("checks"), "status")


_DOCS = "d as (select doc_id, coalesce(text, '') t, lower(source) author, lower(lang) reviewer, quality, toxic from documents join labels using (doc_id))"


@registered("m3_review_faults", f"""with {_DOCS} select doc_id review_id, 'preflight_unknown' fault from d where doc_id % 7 = 0 union all select doc_id, 'reviewer_is_author' from d where reviewer = author
    union all select doc_id, 'accepted_without_pass' from d where quality = 1 and (doc_id % 7 = 0 or toxic is distinct from 0)""")
def m3_review_faults(spark, sf_dir):
    known = F.col("doc_id") % 7 != 0
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("candidate_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    reviews = joined.select(F.col("doc_id").alias("review_id"), "candidate_hash", F.when(known, F.col("candidate_hash")).alias("preflight_hash"), F.col("source").alias("author"), F.col("lang").alias("reviewer"), F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("decision"), F.when(known & (F.col("toxic") == 0), "pass").otherwise("fail").alias("status"))
    return preflight.review_faults(reviews)


@registered("j21_eligible_candidates", f"with {_DOCS} select doc_id from d where toxic = 0 and quality = 1 group by 1")
def j21_eligible_candidates(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").join(labels.select("doc_id", F.when(F.col("toxic") == 0, "pass").otherwise("fail").alias("status")), "doc_id")
    reviews = labels.select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("decision"))
    return preflight.finally_eligible(docs, reviews, "doc_id").distinct()


@registered("p31_unlisted_art_texts", "with t as (select conv_id, list(distinct lower(role)) detected, list(distinct lower(role)) filter (turn % 2 = 0) allowed from conversations group by 1) select conv_id, len(list_filter(detected, lambda x: not list_contains(coalesce(allowed, []), x))) unlisted from t")
def p31_unlisted_art_texts(spark, sf_dir):
    told = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set(F.lower("role")).alias("detected"), F.collect_set(F.when(F.col("turn") % 2 == 0, F.lower("role"))).alias("allowed"))
    return told.select("conv_id", F.size(preflight.unlisted(F.col("detected"), F.col("allowed"))).cast("bigint").alias("unlisted"))
