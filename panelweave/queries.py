"""The registered queries of the engine and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.columns import content_hash, largest_difference
from panelweave.functions.text import page_id
from panelweave.operators import clusters, dialogue, integrity, lanes, learning, rules, sequence, tasks
from panelweave.registry import ATTEMPTS, BLOCKS, EVENTS, FILES, QUERIES, SQL, STORY, balanced_sql, registered
from panelweave.sources.tables import attempts, story_pages, table, task_events, url_pages
from panelweave.streaming.events import KINDS, window_metrics


@registered("w3_batches", f"""with {STORY}, dealt as (select *, {balanced_sql('pos', 'total', 12)} batch from story),
    ctx as (select *, coalesce(list(page_id) over (partition by project_id order by pos rows between 2 preceding and 1 preceding), []) pre, coalesce(list(page_id) over (partition by project_id order by pos rows between 1 following and 2 following), []) post from dealt),
    made as (select project_id, batch, count(*) size, string_agg(cast(page_id as varchar), ',' order by pos) members, array_to_string(arg_min(pre, pos), ',') before, array_to_string(arg_max(post, pos), ',') after from ctx group by 1, 2)
    select *, sha256(project_id || '|' || members) batch_id from made""")
def w3_batches(spark, sf_dir):
    return sequence.batches(story_pages(spark, sf_dir))


_PAGE_FILES = rf"""{FILES}, stems as (select *, regexp_replace(regexp_replace(translate(regexp_replace(name, '^(.+)\.[^.]+$', '\1'), '（）', '()'), '^\s+', ''), '\s+$', '') stem, lower(regexp_extract(name, '.(\.[^.]+)$', 1)) suffix from files),
    told as (select *, regexp_full_match(stem, '\d+\s*(\(\s*\d+\s*\))?') numeric_ from stems),
    keyed as (select *, case when numeric_ then cast(regexp_extract(stem, '^(\d+)', 1) as hugeint) end num, case when numeric_ then cast(coalesce(nullif(regexp_extract(stem, '\(\s*(\d+)\s*\)$', 1), ''), '0') as hugeint) end variant,
        case when not numeric_ then list_transform(regexp_extract_all(lower(stem), '\d+|\D+'), lambda p: case when regexp_matches(p, '^\d') then {{'k': 0, 'n': cast(p as hugeint), 't': ''}} else {{'k': 1, 'n': cast(0 as hugeint), 't': p}} end) end tokens from told)"""


@registered("w1_story_index", rf"""with {_PAGE_FILES}, numbered as (select project_id, page_id, name, row_number() over (partition by project_id order by case when numeric_ then 0 else 1 end, num, variant, tokens, case when not numeric_ then suffix end, lower(name), name, page_id) "index" from keyed)
    select *, printf('%04d.jpg', "index") output_name from numbered""")
def w1_story_index(spark, sf_dir):
    return sequence.story_index(url_pages(spark, sf_dir)).select("project_id", "page_id", "name", "index", "output_name")


@registered("s2_repeated_pages", rf"""with {_PAGE_FILES}, c as (select project_id, page_id, name, count(*) over (partition by project_id, numeric_, num, variant, case when not numeric_ then lower(regexp_replace(stem, '\s+', '', 'g')) end) copies from keyed) select * from c where copies > 1""")
def s2_repeated_pages(spark, sf_dir):
    return sequence.repeated_pages(url_pages(spark, sf_dir))


@registered("p1_page_identity", rf"""with {FILES} select project_id, page_id, nullif(regexp_extract(translate(regexp_replace(trim(name), '\.[^.]*$', ''), '（）', '()'), '^[A-Za-z0-9]+(\([0-9]+\))?$', 0), '') identity from files""")
def p1_page_identity(spark, sf_dir):
    return url_pages(spark, sf_dir).select("project_id", "page_id", page_id(F.col("name")).alias("identity"))


_RUNS = f"{STORY}, keyed as (select *, concat_ws(chr(31), chapter, location, story_time, scene_id) \"key\" from story), turns as (select *, case when \"key\" is distinct from lag(\"key\") over (partition by project_id order by pos) then 1 else 0 end turn from keyed), runs as (select *, sum(turn) over (partition by project_id order by pos) run from turns)"


@registered("w4_scene_runs", f"with {_RUNS} select project_id, run, count(*) size, min(page_id) first_page, max(page_id) last_page from runs group by 1, 2")
def w4_scene_runs(spark, sf_dir):
    return sequence.scene_runs(story_pages(spark, sf_dir)).groupBy("project_id", "run").agg(F.count("*").alias("size"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"))


@registered("w8_scene_chunks", f"""with {_RUNS}, spots as (select *, row_number() over (partition by project_id, run order by pos) - 1 spot, count(*) over (partition by project_id, run) n from runs), c as (select *, {balanced_sql('spot', 'n', 20)} chunk from spots)
    select project_id, run, chunk, count(*) size, arg_min(page_id, pos) first_page, first(page_id order by risk desc nulls last, pos) canary from c group by 1, 2, 3""")
def w8_scene_chunks(spark, sf_dir):
    return sequence.scene_chunks(story_pages(spark, sf_dir))


@registered("j11_style_neighbours", f"""with {STORY} select a.project_id, a.page_id, a.pos from story a where not exists (select 1 from story b where a.project_id = b.project_id and a.location is not distinct from b.location and a.pos <> b.pos and abs(a.pos - b.pos) <= 2)""")
def j11_style_neighbours(spark, sf_dir):
    return sequence.style_neighbours(story_pages(spark, sf_dir))


@registered("w13_failure_streaks", f"""with {EVENTS}, moves as (select *, case when kind = 'fail' then code end fc, kind = 'fail' is_fail from ev where kind in ('fail', 'complete', 'reopen')),
    turns as (select *, case when is_fail and coalesce(lag(is_fail) over w, false) and fc is not distinct from lag(fc) over w then 0 else 1 end turn from moves window w as (partition by lane order by ts, event_id)),
    runs as (select *, sum(turn) over (partition by lane order by ts, event_id) run from turns)
    select lane, event_id, code, row_number() over (partition by lane, run order by ts, event_id) streak, row_number() over (partition by lane, run order by ts, event_id) >= 3 paused from runs where is_fail""")
def w13_failure_streaks(spark, sf_dir):
    return tasks.failure_streaks(task_events(spark, sf_dir))


@registered("w16_latest_states", f"with {EVENTS} select lane, first(kind order by ts desc, event_id desc) state, max(event_id) last_event, count(*) events from ev group by 1")
def w16_latest_states(spark, sf_dir):
    return tasks.latest_states(task_events(spark, sf_dir))


@registered("a8_queue_metrics", f"""with {EVENTS}, c as (select project_id, {', '.join(f"count(*) filter (kind = '{k}') n_{k}" for k in ('add', 'claim', 'complete', 'fail', 'reopen'))} from ev group by 1),
    r as (select project_id, sum(n - 1) repeats from (select project_id, lane, code, count(*) n from ev where kind = 'fail' group by 1, 2, 3) group by 1)
    select c.*, cast(coalesce(repeats, 0) as bigint) repeats, round(case when n_fail = 0 then 0.0 else coalesce(repeats, 0)::double / n_fail end, 6) repeat_rate from c left join r using (project_id)""")
def a8_queue_metrics(spark, sf_dir):
    return tasks.queue_metrics(task_events(spark, sf_dir))


@registered("a7_failures_by_code", f"with {EVENTS} select project_id, code, count(*) failures, count(distinct lane) lanes from ev where kind = 'fail' group by 1, 2")
def a7_failures_by_code(spark, sf_dir):
    return tasks.failures_by_code(task_events(spark, sf_dir))


@registered("a9_cache_use", f"with {EVENTS}, v as (select cache_key, case when value > 100 then 1 else 0 end hit from ev where kind = 'claim') select cache_key, cast(sum(hit) as bigint) hits, cast(sum(1 - hit) as bigint) misses, round(sum(hit)::double / count(*), 6) hit_rate from v group by rollup (cache_key)")
def a9_cache_use(spark, sf_dir):
    return tasks.cache_use(task_events(spark, sf_dir))


@registered("j15_overlapping_leases", f"with {EVENTS}, c as (select *, max(ts + interval 6 hours) over (partition by lane order by ts, event_id rows between unbounded preceding and 1 preceding) held from ev where kind = 'claim') select lane, event_id from c where ts < held")
def j15_overlapping_leases(spark, sf_dir):
    return tasks.overlapping_leases(task_events(spark, sf_dir))


@registered("a17_promoted_rules", f"""with {ATTEMPTS}, p as (select signature, page, "character", min(failure_id) source, arg_min(cluster, failure_id) cluster from att group by 1, 2, 3),
    c as (select signature, cluster, "character", count(distinct page) pages from p group by 1, 2, 3 having count(distinct page) >= 2), j as (select signature, "character", count(distinct cluster) clusters from c group by 1, 2 having count(distinct cluster) >= 2)
    select 'page' "scope", signature, "character", cast(page as varchar) place, 1::bigint sources from p union all select 'cluster', signature, "character", cast(cluster as varchar), pages from c union all select 'project', signature, "character", null, clusters from j union all select 'skill_candidate', signature, "character", null, 1::bigint from j""")
def a17_promoted_rules(spark, sf_dir):
    return learning.promoted(attempts(spark, sf_dir))


@registered("p14_failure_signatures", "select l_returnflag, l_linestatus, count(*) n, sha256('{\"l_linestatus\":\"' || l_linestatus || '\",\"l_returnflag\":\"' || l_returnflag || '\"}') signature from lineitem group by 1, 2")
def p14_failure_signatures(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).withColumn("signature", content_hash("l_returnflag", "l_linestatus"))


@registered("j1_bijection_faults", """with i as (select o_orderkey k, count(*) n from orders group by 1), o as (select l_orderkey k, count(*) n from lineitem group by 1),
    b as (select coalesce(i.k, o.k) "key", coalesce(i.n, 0) n_in, coalesce(o.n, 0) n_out from i full join o on i.k = o.k)
    select *, case when n_out = 0 then 'missing' when n_in = 0 then 'extra' else 'repeated' end fault from b where n_out = 0 or n_in = 0 or n_in > 1 or n_out > 1""")
def j1_bijection_faults(spark, sf_dir):
    return integrity.bijection_faults(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@registered("a1_repeated_rows", "select l_orderkey, l_linenumber, count(*) copies from lineitem group by 1, 2 having count(*) > 1")
def a1_repeated_rows(spark, sf_dir):
    return integrity.repeated(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@registered("d3_resolved_facts", """with t as (select o_custkey subject, o_orderstatus value, o_orderpriority priority, rank() over (partition by o_custkey order by o_orderpriority) r from orders)
    select subject, min(priority) priority, count(distinct value) "values", min(value) value, count(distinct value) > 1 conflict from t where r = 1 group by 1""")
def d3_resolved_facts(spark, sf_dir):
    return integrity.resolved(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("value"), F.col("o_orderpriority").alias("priority")))


@registered("j18_self_reviews", """select o_orderkey unit, c_nationkey reviewer from orders join customer on o_custkey = c_custkey
    where exists (select 1 from lineitem join supplier on l_suppkey = s_suppkey where l_orderkey = o_orderkey and s_nationkey = c_nationkey)""")
def j18_self_reviews(spark, sf_dir):
    read = lambda name: table(spark, sf_dir, name)
    made = read("lineitem").join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("unit"), F.col("s_nationkey").alias("generator"))
    reviewed = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("unit"), F.col("c_nationkey").alias("reviewer"))
    return integrity.self_reviews(made, reviewed)


@registered("p27_channel_deltas", """select a.vec_id, round(list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::double - z[2]::double))), 6) delta from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def p27_channel_deltas(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return vectors.join(after, "vec_id").select("vec_id", largest_difference("embedding", "next").alias("delta"))


def _blocks(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("block"), F.col("role").alias("speaker"), "text")


@registered("a12_dialogue_density", f"""with {BLOCKS}, v as (select *, length(regexp_replace(text, '\\s', '', 'g')) n from blocks) select page, count(*) blocks, cast(sum(n) as bigint) visible, count(*) filter (n > 25) over_budget, count(distinct speaker) speakers from v group by 1""")
def a12_dialogue_density(spark, sf_dir):
    return dialogue.density(_blocks(spark, sf_dir))


@registered("d4_unowned_balloons", f"with {BLOCKS} select page, block, count(distinct speaker) owners from blocks group by 1, 2 having count(distinct speaker) <> 1")
def d4_unowned_balloons(spark, sf_dir):
    return dialogue.unowned(_blocks(spark, sf_dir))


@registered("r10_source_hashes", "select conv_id, sha256(string_agg(text, chr(10) order by turn, role, text)) source_hash from conversations group by 1")
def r10_source_hashes(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n"), 256).alias("source_hash"))


_PARTS = ", ".join(f"coalesce(nullif(trim({c}), ''), 'unknown') {c}" for c in clusters.SCENE)
_ONE = lambda c: f"case when min({c}) = max({c}) then min({c}) else 'mixed' end {c}"


@registered("w9_scene_clusters", rf"""with recursive {STORY}, s as (select project_id, page_id, pos, total, risk, {_PARTS} from story),
    t as (select *, case when (chapter, location, story_time, scene_id) is distinct from lag((chapter, location, story_time, scene_id)) over (partition by project_id order by pos) then 1 else 0 end turn from s),
    r as (select *, sum(turn) over (partition by project_id order by pos) run from t), a as (select *, row_number() over (partition by project_id, run order by pos) - 1 at_, count(*) over (partition by project_id, run) rn from r), k as (select *, {balanced_sql('at_', 'rn', 20)} chunk from a),
    ch as (select project_id, run, chunk, chapter, location, count(*) n from k group by all), cs as (select *, case when (chapter, location) is distinct from lag((chapter, location)) over (partition by project_id order by run, chunk) then 1 else 0 end turn from ch),
    st as (select *, sum(turn) over (partition by project_id order by run, chunk) stretch from cs), li as (select project_id, stretch, min(run) first_run, bool_or(chapter = 'unknown' or location = 'unknown') loose, list(n order by run, chunk) sizes from st group by 1, 2),
    fold as (select project_id, stretch, cast([] as struct(s bigint, c bigint)[]) done, list_transform(sizes, lambda x: {{'s': x, 'c': 1::bigint}}) ahead from li
        union all select project_id, stretch, case when big or not (back or on_) then list_append(done, ahead[1]) when back then done[:-2] else done end, case when big or not (back or on_) then ahead[2:] when back then list_prepend({{'s': done[-1].s + ahead[1].s, 'c': done[-1].c + ahead[1].c}}, ahead[2:]) else list_prepend({{'s': ahead[1].s + ahead[2].s, 'c': ahead[1].c + ahead[2].c}}, ahead[3:]) end
        from (select *, ahead[1].s >= 8 big, len(done) > 0 and done[-1].s + ahead[1].s <= 20 back, len(ahead) > 1 and ahead[1].s + ahead[2].s <= 20 on_ from fold where len(ahead) > 0)),
    g0 as (select project_id, stretch, generate_subscripts(done, 1) - 1 g, unnest(done).c c from fold where len(ahead) = 0), g1 as (select *, coalesce(sum(c) over (partition by project_id, stretch order by g rows between unbounded preceding and 1 preceding), 0) lo from g0),
    sn as (select st.*, first_run, loose, row_number() over (partition by st.project_id, st.stretch order by run, chunk) - 1 place from st join li on li.project_id = st.project_id and li.stretch = st.stretch),
    gr as (select sn.project_id, run, chunk, first_run, case when loose then place else g end g from sn join g1 on g1.project_id = sn.project_id and g1.stretch = sn.stretch and place >= lo and place < lo + c),
    nm as (select k.*, first_run, g from k join gr on gr.project_id = k.project_id and gr.run = k.run and gr.chunk = k.chunk),
    f as (select project_id, first_run, g, min(pos) lo, max(pos) hi, any_value(total) total, count(*) size, string_agg(page_id, ',' order by pos) members, list(page_id order by pos)[(count(*) - 1) // 2 + 1] middle, arg_max(page_id, (risk, -pos)) filter (risk is not null) worst, string_agg('"' || page_id || '"', ',' order by pos) quoted,
        {_ONE('chapter')}, {_ONE('location')}, case when count(distinct (story_time, scene_id)) = 1 then min(story_time) else 'mixed' end story_time, case when count(distinct (story_time, scene_id)) = 1 then min(scene_id) else 'mixed' end scene_id from nm group by 1, 2, 3),
    x as (select f.*, coalesce((select string_agg(page_id, ',' order by pos) from s where s.project_id = f.project_id and pos between lo - 2 and lo - 1), '') "before", coalesce((select string_agg(page_id, ',' order by pos) from s where s.project_id = f.project_id and pos between hi + 1 and hi + 2), '') "after" from f)
    select project_id, row_number() over (partition by project_id order by lo) "cluster", size, members, "before", "after", chapter, location, story_time, scene_id, coalesce(worst, middle) canary, 'cluster-' || substr(sha256('{{"member_pages":[' || quoted || '],"scene_key":["' || chapter || '","' || location || '","' || story_time || '","' || scene_id || '"]}}'), 1, 16) cluster_id,
    case when size < 8 then case when total = size then 'project_total_below_min' else 'scene_fragment_below_min' end end undersized_reason, size < 8 and total <> size blocked from x""")
def w9_scene_clusters(spark, sf_dir):
    return clusters.scene_clusters(story_pages(spark, sf_dir))


@registered("w10_migration_clusters", f"""with {STORY}, keyed as (select *, coalesce(risk < 300, true) u, concat_ws(chr(31), {', '.join(f"coalesce(nullif(trim({c}), ''), 'unknown')" for c in clusters.SCENE)}) k from story),
    turns as (select *, case when u or coalesce(lag(u) over w, true) or k is distinct from lag(k) over w then 1 else 0 end turn from keyed window w as (partition by project_id order by pos)),
    runs as (select *, cast(sum(turn) over (partition by project_id order by pos) as bigint) run from turns),
    spots as (select *, (row_number() over (partition by project_id, run order by pos) - 1) // 20 chunk from runs)
    select project_id, run, chunk, count(*) size, arg_min(page_id, pos) first_page, list(page_id order by pos)[(count(*) - 1) // 2 + 1] canary, case when bool_or(u) then 'unresolved' else 'confirmed' end state, 'cluster-' || substr(sha256('{{"alignment_state":"' || case when bool_or(u) then 'unresolved' else 'confirmed' end || '","member_pages":["' || string_agg(cast(page_id as varchar), '","' order by pos) || '"],"scene_key":["' || replace(any_value(k), chr(31), '","') || '"]}}'), 1, 16) cluster_id from spots group by 1, 2, 3""")
def w10_migration_clusters(spark, sf_dir):
    return clusters.migration_clusters(story_pages(spark, sf_dir).withColumn("unresolved", F.coalesce(F.col("risk") < 300, F.lit(True))))


_FAILS = "m.kind = 'fail'"
_STREAK = "case when l[m.lane].n is not null and l[m.lane].code is not distinct from m.code then l[m.lane].n + 1 else 1 end"
_PROMPTED = "case when m.prompt is null then 0 else coalesce(p[m.prompt], 0) + 1 end"
_PAUSES = f"{_FAILS} and not map_contains(z, m.lane) and greatest({_STREAK}, {_PROMPTED}) >= 3"
_without = lambda held, key: f"map_from_entries(list_filter(map_entries({held}), lambda e: e.key is distinct from {key}))"


@registered("st3_lane_pauses", f"""with recursive {EVENTS}, m as (select project_id, lane, event_id, kind, code, cache_key % 7 prompt, row_number() over (partition by project_id order by ts, event_id) n from ev where kind in ('fail', 'complete', 'reopen')),
    walk as (select distinct project_id, 0::bigint n, map_from_entries(cast([] as struct(k bigint, v struct(code bigint, n bigint))[])) l, map_from_entries(cast([] as struct(k bigint, v bigint)[])) p, map_from_entries(cast([] as struct(k bigint, v bigint)[])) z, null::bigint lane, null::bigint event_id, null::bigint code, null::varchar reason from m
        union all select m.project_id, m.n, case when {_FAILS} then map_concat(l, map([m.lane], [{{'code': m.code, 'n': ({_STREAK})::bigint}}])) else {_without('l', 'm.lane')} end,
        case when {_FAILS} then case when m.prompt is null then p else map_concat(p, map([m.prompt], [({_PROMPTED})::bigint])) end when m.kind = 'complete' then {_without('p', 'm.prompt')} when z[m.lane] is not null then {_without('p', 'z[m.lane]')} else p end,
        case when {_PAUSES} then map_concat(z, map([m.lane], [m.prompt])) when m.kind = 'reopen' then {_without('z', 'm.lane')} else z end,
        m.lane, m.event_id, m.code, case when {_PAUSES} then case when {_STREAK} >= 3 then 'lane_failure_streak' else 'prompt_failure_streak' end end
        from walk join m on m.project_id = walk.project_id and m.n = walk.n + 1)
    select project_id, lane, event_id, code, reason from walk where reason is not null""")
def st3_lane_pauses(spark, sf_dir):
    return lanes.pauses(task_events(spark, sf_dir))


@registered("j14_canary_gates", f"""with {EVENTS}, l as (select lane, first(event_id order by ts, event_id) canary, first(kind order by ts, event_id) k, bool_or(kind = 'complete') approved, count(*) filter (kind = 'claim') n from ev group by 1)
    select lane, canary, approved, case when approved then 0 else n - case when k = 'claim' then 1 else 0 end end waiting from l""")
def j14_canary_gates(spark, sf_dir):
    return lanes.canary_gates(task_events(spark, sf_dir))


@registered("a4_lease_ends", f"""with {EVENTS}, n as (select *, lead(ts) over (partition by lane order by ts, event_id) nxt from ev)
    select project_id, count(*) claims, count(*) filter (ts + interval 6 hours <= nxt) expired, count(*) filter (nxt is null) "open" from n where kind = 'claim' group by 1""")
def a4_lease_ends(spark, sf_dir):
    return lanes.lease_ends(task_events(spark, sf_dir))


_STEPS = f"{EVENTS}, steps as (select *, lag(kind) over (partition by lane order by ts, event_id) was from ev)"


@registered("d1_skipped_states", f"""with {_STEPS}, r as (select *, map {{'add': 1, 'claim': 2, 'complete': 3, 'fail': 3, 'reopen': 4}} m from steps) select lane, event_id, was, kind from r where was is not null and m[kind] > m[was] + 1""")
def d1_skipped_states(spark, sf_dir):
    return lanes.skipped_states(task_events(spark, sf_dir))


@registered("d2_illegal_moves", f"with {_STEPS} select lane, event_id, was, kind from steps where was is not null and was || '>' || kind not in ('add>claim', 'claim>claim', 'claim>complete', 'claim>fail', 'fail>reopen', 'reopen>claim')")
def d2_illegal_moves(spark, sf_dir):
    return lanes.illegal_moves(task_events(spark, sf_dir))


@registered("d7_handoffs", f"""with {EVENTS}, t as (select *, count(*) filter (kind = 'complete') over (partition by lane order by ts, event_id) n from ev),
    c as (select *, lag(code) over w was_code, lag(n) over w was_n from t where kind = 'claim' window w as (partition by lane order by ts, event_id)) select lane, event_id, was_code, code from c where was_code <> code and was_n = n""")
def d7_handoffs(spark, sf_dir):
    return lanes.unexplained_handoffs(task_events(spark, sf_dir))


@registered("st1_first_adds", f"with {EVENTS} select lane, first(event_id order by ts, event_id) event_id, count(*) - 1 repeats from ev where kind = 'add' group by 1")
def st1_first_adds(spark, sf_dir):
    return lanes.first_adds(task_events(spark, sf_dir))


@registered("st7_daily_metrics", f"""with {EVENTS} select cast(cast(ts as date) as varchar) "day", {', '.join(f"count(*) filter (kind = '{k}') n_{k}" for k in KINDS)} from ev group by 1""")
def st7_daily_metrics(spark, sf_dir):
    return window_metrics(task_events(spark, sf_dir)).withColumn("day", F.date_format("start", "yyyy-MM-dd")).drop("start")


@registered("p20_slice_checks", f"""with {BLOCKS}, b as (select page, block, speaker, coalesce(text, '') t from blocks),
    s as (select *, coalesce(sum(length(t) + 1) over (partition by page order by block, speaker, t rows between unbounded preceding and 1 preceding), 0) "start" from b),
    e as (select *, lag("start" + length(t)) over (partition by page order by block, speaker, t) past from s), n as (select page, string_agg(t, chr(10) order by block, speaker, t) src from b group by 1)
    select page, count(*) blocks, max(length(src)) length, count(*) filter (substr(src, cast("start" as bigint) + 1, length(t)) = t) equal, count(*) filter ("start" < past) "overlaps" from e join n using (page) group by 1""")
def p20_slice_checks(spark, sf_dir):
    return dialogue.slice_checks(_blocks(spark, sf_dir))


@registered("r2_text_requests", f"""with {BLOCKS}, b as (select page, block, coalesce(speaker, '') s, coalesce(text, '') t from blocks),
    m as (select page, string_agg('[' || block || '] ' || s || ': ' || t, chr(10) order by block, s, t) r, bool_or(length(regexp_replace(t, '\\s', '', 'g')) > 25) needs_reason from b group by 1) select page, length(r) length, sha256(r) request_hash, needs_reason from m""")
def r2_text_requests(spark, sf_dir):
    return dialogue.text_requests(_blocks(spark, sf_dir))


@registered("g2_revoked_rules", f"""with {ATTEMPTS}, p as (select signature, page, "character", arg_min(cluster, failure_id) cluster, page % 10 = 0 gone from att group by 1, 2, 3),
    c as (select signature, cluster, "character", bool_or(gone) gone from p group by 1, 2, 3 having count(distinct page) >= 2), j as (select signature, "character", bool_or(gone) gone from c group by 1, 2 having count(distinct cluster) >= 2)
    select 'page' "scope", signature, "character", cast(page as varchar) place from p where gone union all select 'cluster', signature, "character", cast(cluster as varchar) from c where gone union all select s, signature, "character", null from j, (values ('project'), ('skill_candidate')) v(s) where gone""")
def g2_revoked_rules(spark, sf_dir):
    return learning.revoked(attempts(spark, sf_dir), F.col("page") % 10 == 0)


@registered("j13_applicable_rules", f"""with {ATTEMPTS}, p as (select signature, page, "character", arg_min(cluster, failure_id) cluster from att group by 1, 2, 3), c as (select signature, cluster, "character" from p group by 1, 2, 3 having count(distinct page) >= 2), j as (select signature, "character" from c group by 1, 2 having count(distinct cluster) >= 2),
    q as (select distinct l_orderkey page, l_suppkey cluster, l_linestatus "character", l_returnflag signature from lineitem where not (l_quantity > 48 and l_discount >= 0.09)),
    r as (select q.*, p.page is not null a, c.cluster is not null b, j.signature is not null d from q left join p on p.page = q.page and p."character" = q."character" and p.signature = q.signature left join c on c.cluster = q.cluster and c."character" = q."character" and c.signature = q.signature left join j on j."character" = q."character" and j.signature = q.signature)
    select page, cluster, "character", signature, cast(a as bigint) + cast(b as bigint) + 2 * cast(d as bigint) rules, case when a then 'page' when b then 'cluster' when d then 'project' end "leading" from r""")
def j13_applicable_rules(spark, sf_dir):
    return learning.applicable(attempts(spark, sf_dir))


@registered("j12_illegal_policies", f"""with r as (select doc_id, case when quality = 1 then 'unchanged_copy' else 'edited' end a, case when quality = 1 then 'unchanged' when toxic = 1 then 'visual' else 'text_only' end s, n_chars > 500 h, ['reliable', 'unreliable', 'not_applicable'][doc_id % 3 + 1] k from documents join labels using (doc_id)),
    f as (select *, case when s = 'unchanged' then 'none' when s = 'visual' then case when h then 'page' else 'none' end when k = 'reliable' then 'block' else 'page' end m, case when s = 'unchanged' then 'unchanged_page' when s = 'visual' then case when h then 'visual_repair_requires_page_reset' else 'no_ordinary_text' end when k = 'reliable' then 'reliable_block_match' else 'unreliable_text_page_reset' end w from r)
    select doc_id from f where h is null or not coalesce(({' or '.join(f"(a = '{a}' and s = '{s}' and k = '{k}' and m = '{m}' and w = '{w}'" + ("" if h == "any" else f" and h = {h}") + ")" for a, s, h, k, m, w in rules.POLICIES)}), false)""")
def j12_illegal_policies(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    scope = F.when(F.col("quality") == 1, "unchanged").when(F.col("toxic") == 1, "visual").otherwise("text_only")
    rows = joined.select("doc_id", F.when(F.col("quality") == 1, "unchanged_copy").otherwise("edited").alias("action"), scope.alias("repair_scope"), (F.col("n_chars") > 500).alias("had_text"), F.element_at(F.array(*map(F.lit, ("reliable", "unreliable", "not_applicable"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("recognition"))
    still, seen, sure = F.col("repair_scope") == "unchanged", F.col("repair_scope") == "visual", F.col("recognition") == "reliable"
    pick = lambda none, page, bare, block, reset: F.when(still, none).when(seen & F.col("had_text"), page).when(seen, bare).when(sure, block).otherwise(reset)
    rows = rows.withColumn("reset_mode", pick("none", "page", "none", "block", "page")).withColumn("reason", pick("unchanged_page", "visual_repair_requires_page_reset", "no_ordinary_text", "reliable_block_match", "unreliable_text_page_reset"))
    return rules.illegal_policies(rows, "doc_id")


_SPELLED = ("Copy-Original", " no_change", "Text-Repair", "page_reset", "REDRAW", "regenerate", "unknown", "")


@registered("p22_task_classes", f"""with r as (select source project_id, lang is null u, replace(lower(trim({list(_SPELLED)}[doc_id % 8 + 1])), '-', '_') a from documents)
    select project_id, {', '.join("case when u then '" + rules.BLOCKED[i] + "' " + ' '.join(f"when a in {names} then '{kind[i]}'" for kind, names in rules.CLASSES.items()) + f" else '{rules.BLOCKED[i]}' end {column}" for i, column in enumerate(('page_class', 'task_type')))}, count(*) pages from r group by 1, 2, 3""")
def p22_task_classes(spark, sf_dir):
    action = F.element_at(F.array(*map(F.lit, _SPELLED)), (F.col("doc_id") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.col("lang").isNull().alias("unresolved"), action.alias("action"))
    return rules.with_task_class(rows).groupBy("project_id", "page_class", "task_type").agg(F.count("*").alias("pages"))


@registered("j10_snapshot_changes", """select coalesce(s_suppkey, c_custkey) "key", case when s_suppkey is null then 'added' when c_custkey is null then 'removed' else 'changed' end "change" from supplier full join customer on s_suppkey = c_custkey where s_suppkey is null or c_custkey is null or s_nationkey is distinct from c_nationkey""")
def j10_snapshot_changes(spark, sf_dir):
    before = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("digest"))
    return rules.snapshot_changes(before, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("digest")), "key", "digest")


@registered("v_row_violations", """select doc_id, 'location_missing' rule_id from documents where lang is null union all select doc_id, 'excerpt_empty' from documents where coalesce(trim(text), '') = ''
    union all select doc_id, 'offsets_differ' from documents where n_chars is distinct from length(text) union all select doc_id, 'project_missing' from documents where source is null""")
def v_row_violations(spark, sf_dir):
    faults = {"location_missing": F.col("lang").isNull(), "excerpt_empty": F.coalesce(F.trim("text"), F.lit("")) == "", "offsets_differ": ~F.col("n_chars").eqNullSafe(F.length("text").cast("bigint")), "project_missing": F.col("source").isNull()}
    return rules.violations(table(spark, sf_dir, "documents"), faults, "doc_id")


# the modules of further queries register themselves
from panelweave.plans import audits, bundle, catalogue, compiled, dispatch, evidence, migration, migration_plan, packs, store, task_rules  # noqa: E402, F401
