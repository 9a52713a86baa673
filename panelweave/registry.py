"""The register of the engine's queries, and pieces of SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


STORY = "story as (select coalesce(source, 'none') || '-' || doc_id // 500 project_id, doc_id page_id, source chapter, lang location, case when n_chars < 1000 then 'day' else 'night' end story_time, cast(doc_id % 3 as varchar) scene_id, n_chars risk, row_number() over (partition by coalesce(source, 'none'), doc_id // 500 order by doc_id) - 1 pos, count(*) over (partition by coalesce(source, 'none'), doc_id // 500) total from documents)"
PAGES = "pg as (select coalesce(source, 'none') || '-' || doc_id // 500 project_id, doc_id, lang, n_chars, text, row_number() over (partition by coalesce(source, 'none'), doc_id // 500 order by doc_id) pos, count(*) over (partition by coalesce(source, 'none'), doc_id // 500) n from documents)"
FILES = r"files as (select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) project_id, regexp_extract(url, '([^/]*)$', 1) name from pages)"
EVENTS = "ev as (select user_id // 10 project_id, user_id lane, event_id, ts, case event_type when 'signup' then 'add' when 'view' then 'claim' when 'purchase' then 'complete' when 'error' then 'fail' when 'click' then 'reopen' end kind, cast(json_extract_string(props, '$.k') as bigint) % 2 code, cast(json_extract_string(props, '$.k') as bigint) cache_key, value from events)"
ATTEMPTS = "att as (select l_orderkey page, l_suppkey cluster, l_linestatus \"character\", l_returnflag signature, concat_ws('-', l_orderkey, l_linenumber, l_partkey) failure_id from lineitem where l_quantity > 48 and l_discount >= 0.09)"
BLOCKS = "blocks as (select conv_id page, turn block, role speaker, text from conversations)"


def balanced_sql(pos: str, total: str, most: int) -> str:
    k, size = f"cast(ceil({total} / {most}.0) as bigint)", f"({total} // cast(ceil({total} / {most}.0) as bigint))"
    edge = f"(({total} - {k} * {size}) * ({size} + 1))"
    return f"case when {pos} < {edge} then {pos} // ({size} + 1) else ({total} - {k} * {size}) + ({pos} - {edge}) // {size} end"
